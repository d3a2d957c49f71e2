"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Kinds are email, ip, card and phone. The patterns give the base spans, which always stay. The field labels white-space
tokens as outside, beginning or inside of a kind from the shapes of a token and its two
neighbours: the classes of its characters with repeats collapsed, and how many digits it has. It is trained
by gradient ascent on a small table of labelled texts (at most ``LABELLED_BOUND`` rows); :func:`labelled_rows` makes a
table by rule. Decoding is Viterbi in numpy over all open stretches of a batch at once. A token is closed, and cuts its
text into stretches, when its own scores forbid any label but "outside" whatever its neighbours'
labels are; that bound is exact, so the result is the one of decoding whole texts.

An added span has to overlap no base span and pass its kind's check: the email and ip patterns, 12 to 19
digits with a Luhn sum for cards, 9 to 15 digits for phones.

Null texts are empty texts and have no spans. Rows with a null doc_id and repeated rows are treated like all others. An empty
table gives an empty result. :func:`redact` carries all other columns.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.bytewords import mix, run_hashes, small_batches, small_slices, split_batch

KINDS = ("email", "ip", "card", "phone")
LABELLED_BOUND = 2_000
Span = tuple[int, int, str]

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = _NO_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= len(_NO_DIGIT.sub("", found)) <= 15


def _emails(text: str) -> Iterator[Span]:
    """Matches around each @, which takes time in proportion to the text whatever its runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done, "email"
        else:
            done = max(done, at)  # what stands before this @ can't reach over it
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start and kind."""
    found = list(_emails(text))
    for kind, pattern, valid in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(m.group())]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_VALID = {
    "email": lambda s: any((a, b) == (0, len(s)) for a, b, _ in _emails(s)),
    "ip": lambda s: bool(_IP.fullmatch(s)) and _is_ip(s),
    "card": _is_card,
    "phone": lambda s: _is_phone(s) and not re.search(r"[^0-9\x20().+/-]", s),
}

# ---------------------------------------------------------------- word shapes

_SPLIT = np.ones(256, dtype=np.uint8)
_SPLIT[:33] = 0
_SHAPE = np.full(256, 14, dtype=np.uint8)
for _code, _members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "(", ")", ":", "/", "_", "="), 1):
    _SHAPE[[ord(c) for c in _members]] = _code
_SHAPE[128:] = 1
_TRAILING = np.zeros(256, dtype=bool)
_TRAILING[[ord(c) for c in ".,;:!?\"'"]] = True
_DIGIT_BIN = np.array([0, 1, 2, 3, 4, 5, 5, 5, *[6] * 4, *[7] * 4, 8, 9])
_COARSE = 10 * 8 + 1  # digits, with and without letter, @ and dot; the last is the edge of a text


def token_types(texts: list[str]):
    """Batch of tokens, a hash of each one's type, and its coarse type."""
    b = split_batch(texts, _SPLIT)
    for _ in range(3):
        b.stop = b.stop - ((b.stop - b.start > 1) & _TRAILING[b.raw[b.stop - 1]])
    code = _SHAPE[b.raw]
    fresh = np.empty(len(code), dtype=bool)
    fresh[:1], fresh[1:] = True, code[1:] != code[:-1]
    fresh[b.start] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    shape = run_hashes(code[fresh], before[b.start], before[b.stop])

    def count(members: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(members, dtype=np.int64)])
        return sums[b.stop] - sums[b.start]

    digits = _DIGIT_BIN[np.minimum(count(code == 3), len(_DIGIT_BIN) - 1)]
    coarse = digits * 8 + (count(code <= 2) > 0) * 4 + (count(code == 4) > 0) * 2 + (count(code == 5) > 0)
    return b, mix(shape + digits.astype(np.uint64)), coarse


def _neighbours(values: np.ndarray, doc: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full(len(values), edge), np.full(len(values), edge)
    same = doc[1:] == doc[:-1]
    before[1:][same], after[:-1][same] = values[:-1][same], values[1:][same]
    return before, after


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Weights of types and coarse types (``tables``, one per place in the window) and of label pairs (``steps``)."""

    known: np.ndarray  # sorted hashes of the types seen in training; number 0 is any other type
    tables: list[np.ndarray]
    steps: np.ndarray

    def features(self, texts: list[str]):
        b, types, coarse = token_types(texts)
        at = np.minimum(np.searchsorted(self.known, types), len(self.known) - 1) if len(self.known) else np.zeros(len(types), int)
        number = np.where(self.known[at] == types, at + 1, 0) if len(self.known) else at
        return b, [number, coarse, *_neighbours(coarse, b.doc, _COARSE - 1), *_neighbours(number, b.doc, 0)]

    def decode(self, texts: list[str]):
        """Batch of tokens and the best label of each."""
        b, features = self.features(texts)
        labels = np.zeros(len(b.start), dtype=np.int64)
        # A token stays outside if no label can gain over "outside" by its own scores and any two steps.
        gain = sum((t[:, 1:] - t[:, :1]).max(axis=1)[f] for t, f in zip(self.tables, features))
        pairs = self.steps[:, :, None] + self.steps[None, :, :]
        reach = (pairs[:, 1:, :] - pairs[:, :1, :]).max()
        opened = np.flatnonzero(gain + reach >= 0)
        if len(opened):
            cut = np.flatnonzero((np.diff(opened) > 1) | np.diff(b.doc[opened]).astype(bool)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(opened)]])
            emit = sum(t[f[opened]] for t, f in zip(self.tables, features))
            labels[opened] = viterbi(emit, first, last, self.steps)
        return b, labels


def viterbi(emit: np.ndarray, first: np.ndarray, last: np.ndarray, steps: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Best labels of the stretches emit[first:last], each with label 0 before and after it."""
    out = np.zeros(len(emit), dtype=np.int64)
    order = np.argsort(first - last, kind="stable")  # longest first, so the running ones are a prefix
    for k in range(0, len(order), at_once):
        a, n = first[order[k : k + at_once]], (last - first)[order[k : k + at_once]]
        score, back = steps[0] + emit[a], []
        for t in range(1, n[0]):
            running = np.searchsorted(-n, -t, side="left")
            ways = score[:running, :, None] + steps
            back.append(ways.argmax(axis=1))
            score[:running] = ways.max(axis=1) + emit[a[:running] + t]
        label = (score + steps[:, 0]).argmax(axis=1)
        for t in range(n[0] - 1, -1, -1):
            running = np.searchsorted(-n, -t, side="left")
            out[a[:running] + t] = label[:running]
            if t:
                label[:running] = back[t - 1][np.arange(running), label[:running]]
    return out


def train(rows: list[tuple[str, list[Span]]], rounds: int = 200, rate: float = 0.1, ridge: float = 3e-4, step_ridge: float = 1e-2) -> Field:
    """Penalised likelihood by gradient ascent with adaptive steps, all texts in one batch.

    The penalty on label pairs keeps them small against the tokens' own scores, so that most tokens are closed.
    """
    texts = [t for t, _ in rows]
    n_labels = 1 + 2 * len(KINDS)
    b, types, _ = token_types(texts)
    field = Field(np.unique(types), [], np.zeros((n_labels, n_labels)))
    b, features = field.features(texts)
    sizes = [len(field.known) + 1, _COARSE, _COARSE, _COARSE, len(field.known) + 1, len(field.known) + 1]
    field.tables = [np.zeros((s, n_labels)) for s in sizes]
    gold = _gold(rows, b)
    lengths = np.bincount(b.doc, minlength=len(texts)) if len(b.doc) else np.zeros(len(texts), int)
    width = int(lengths.max(initial=0))
    if not width:
        return field
    column = np.arange(len(b.doc)) - (np.cumsum(lengths) - lengths)[b.doc]
    mask = np.zeros((len(texts), width), dtype=bool)
    mask[b.doc, column] = True
    weights = [*field.tables, field.steps]
    squares = [np.zeros_like(w) for w in weights]
    moment = [np.zeros_like(w) for w in weights]
    truth = np.zeros((len(b.doc), n_labels))
    truth[np.arange(len(gold)), gold] = 1
    padded_gold = np.zeros((len(texts), width + 2), dtype=np.int64)
    padded_gold[b.doc, column + 1] = gold
    inner = np.concatenate([np.ones((len(texts), 1), bool), mask], axis=1)  # a step from each place to the next, the last one to the end
    true_steps = np.zeros_like(field.steps)
    np.add.at(true_steps, (padded_gold[:, :-1][inner], padded_gold[:, 1:][inner]), 1)
    for k in range(1, rounds + 1):
        emit = np.full((len(texts), width, n_labels), -1e9)
        emit[..., 0] = 0  # places after the end can only be outside
        emit[b.doc, column] = sum(t[f] for t, f in zip(field.tables, features))
        chance, pairs = _expected(emit, field.steps, inner)
        wrong = truth - chance[b.doc, column]
        slopes = []
        for t, f in zip(field.tables, features):
            slope = np.zeros_like(t)
            np.add.at(slope, f, wrong)
            slopes.append(slope)
        slopes.append(true_steps - pairs)
        for w, slope, m, s in zip(weights, slopes, moment, squares):
            slope = slope / len(texts) - (step_ridge if w is field.steps else ridge) * w
            m += 0.1 * (slope - m)
            s += 0.001 * (slope * slope - s)
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return field


def _expected(emit: np.ndarray, steps: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each label at each place, and the expected number of each step between labels."""
    n, width, size = emit.shape
    jump = np.exp(steps)
    scaled = np.exp(emit - emit.max(axis=2, keepdims=True))
    ahead, behind = np.empty((n, width, size)), np.empty((n, width, size))
    row = jump[0] * scaled[:, 0]
    ahead[:, 0] = row / row.sum(axis=1, keepdims=True)
    for t in range(1, width):
        row = (ahead[:, t - 1] @ jump) * scaled[:, t]
        ahead[:, t] = row / row.sum(axis=1, keepdims=True)
    behind[:, -1] = jump[:, 0]
    for t in range(width - 2, -1, -1):
        row = (scaled[:, t + 1] * behind[:, t + 1]) @ jump.T
        behind[:, t] = row / row.sum(axis=1, keepdims=True)
    chance = ahead * behind
    chance /= chance.sum(axis=2, keepdims=True)
    pairs = np.zeros_like(steps)
    pairs[0] += chance[:, 0].sum(axis=0)
    for t in range(1, width):
        joint = ahead[:, t - 1, :, None] * jump * (scaled[:, t] * behind[:, t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[inner[:, t]].sum(axis=0)
    full = inner[:, -1]
    pairs[:, 0] += chance[full, -1].sum(axis=0)
    return chance, pairs


def _gold(rows: list[tuple[str, list[Span]]], b) -> np.ndarray:
    """Label of each token: 0, or 1 + 2 kind for the first token of a span and 2 + 2 kind for its others."""
    out = np.zeros(len(b.start), dtype=np.int64)
    for i, (text, spans) in enumerate(rows):
        base = b.edges[i - 1] if i else 0
        mine = np.flatnonzero(b.doc == i)
        for start, stop, kind in spans:
            x, y = (base + len(text[:at].encode()) for at in (start, stop))
            inside = mine[(b.start[mine] < y) & (b.stop[mine] > x)]
            out[inside] = 2 + 2 * KINDS.index(kind)
            out[inside[:1]] -= 1
    return out


# ---------------------------------------------------------------- the labelled table


def labelled_rows(n: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Invented sentences with personal data in many written forms, and things that only look like it."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(("an", "er", "st", "li", "ou", "é", "ha", "ti", "ch", "r")) for _ in range(rnd.randint(1, 4)))
    part = lambda: str(rnd.randint(0, 255))
    positive = {
        "email": (lambda: f"{word()}.{d(2)}@mail{d(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word().title()}_{word()}@{word()}.co.uk", lambda: f"{word()}+{word()}@{word()}-{word()}.net"),
        "ip": (lambda: ".".join((part(), part(), part(), part())),),
        "card": (lambda: d(16), lambda: " ".join((d(4), d(4), d(4), d(4))), lambda: "-".join((d(4), d(4), d(4), d(4))), lambda: f"{d(4)} {d(6)} {d(5)}"),
        "phone": (lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"+{d(11)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
    }
    negative = (
        lambda: f'token = "{rnd.getrandbits(160):040x}"', lambda: f"password={rnd.getrandbits(72):018x}", lambda: f"version {d(1)}.{d(1)}.", lambda: f"v{d(1)}.{d(1)}.{d(2)}",
        lambda: f"20{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: f"{word()}{rnd.choice(('%%%', '***', '###', '&&&', '$$$'))}", lambda: f"{word().upper()}!!", lambda: f"{word()} | {word()} |", lambda: f"{d(2)}-{d(2)}", lambda: d(rnd.randint(1, 8)),
        lambda: f"{word()}@", lambda: f"@{word()}", lambda: f"({word()})", lambda: f"{word()}_{word()} = {d(2)};", lambda: f"https://{word()}.org/{word()}/{d(4)}", lambda: f"{word()}-{word()}",
        lambda: f"{d(3)} {d(3)} {d(2)}", lambda: f"§ {d(1)}.{d(1)}.{d(1)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
    )
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(1, 4)):
            text += " ".join(word().title() if rnd.random() < 0.15 else word() for _ in range(rnd.randint(1, 7))) + rnd.choice((" ", " ", ", ", ".\n"))
            if rnd.random() < 0.55:
                kind = rnd.choice(KINDS)
                piece = rnd.choice(positive[kind])()
                spans.append((len(text), len(text) + len(piece), kind))
            else:
                piece = rnd.choice(negative)()
            text += piece + rnd.choice((" ", " ", ", ", ". "))
        rows.append((text + word(), spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """The default labelled table: (text, spans), spans with start, stop and kind."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<start: int, stop: int, kind: string>>")


def fit(labelled: DataFrame, bound: int = LABELLED_BOUND) -> Field:
    """Train on at most ``bound`` rows, the first by text."""
    rows = labelled.filter("text is not null").orderBy("text").limit(bound).collect()
    return train([(r["text"], [tuple(s) for s in r["spans"] or []]) for r in rows])


# ---------------------------------------------------------------- operators


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    out: list[tuple[list[Span], list[Span]]] = [(base_spans(t), []) for t in texts]
    for part in small_batches(texts):
        b, labels = field.decode(texts[part])
        kind = (labels + 1) // 2
        tagged = np.flatnonzero(labels)
        if not len(tagged):
            continue
        opens = np.ones(len(tagged), dtype=bool)
        opens[1:] = (np.diff(tagged) > 1) | (np.diff(kind[tagged]) != 0) | (np.diff(b.doc[tagged]) != 0)
        places = np.flatnonzero(opens | (labels[tagged] % 2 == 1))
        first, last = tagged[places], tagged[np.append(places[1:], len(tagged)) - 1]
        points = np.concatenate([[0], np.cumsum((b.raw & 0xC0) != 0x80)])  # code points before each byte
        bases = np.concatenate([[0], b.edges])[b.doc[first]]
        begins, ends = points[b.start[first]] - points[bases], points[b.stop[last]] - points[bases]
        held: tuple[int, np.ndarray, np.ndarray] | None = None  # a text's base spans: starts, and the furthest end up to each
        for doc, x, y, which in zip(b.doc[first].tolist(), begins.tolist(), ends.tolist(), kind[first].tolist()):
            text, (base, added) = texts[part][doc], out[part.start + doc]
            if held is None or held[0] != doc:
                starts, stops = np.array(sorted((s, e) for s, e, _ in base), dtype=np.int64).reshape(-1, 2).T
                held = doc, starts, np.maximum.accumulate(stops)
            before = int(np.searchsorted(held[1], y))
            name = KINDS[which - 1]
            if (not before or held[2][before - 1] <= x) and _VALID[name](text[x:y]):
                added.append((x, y, name))
    return out


def find_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, base, added), both arrays of (start, stop, kind) in code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<start: int, stop: int, kind: string>>"
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], shared.value)
            columns = [pa.array([[dict(zip(("start", "stop", "kind"), s)) for s in in_order(side[i])] for side in found], arrow_span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "base", "added"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, f"doc_id {kind}, base {span}, added {span}").withColumnRenamed("doc_id", id_col)


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in angle brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, text_col):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], shared.value)
            cleaned = [None if t is None else cut_out(t, in_order(base + added)) for t, (base, added) in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(cleaned, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def cut_out(text: str, spans: list[Span]) -> str:
    """Overlapping spans are cut as one, under the kind of the first."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def digest(base: list[Span]) -> str:
    return hashlib.sha256(written(base).encode()).hexdigest()
