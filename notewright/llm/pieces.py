"""SentencePiece ids by streaming Viterbi, and back to text.

The lattice has a node per character boundary and an edge per vocabulary piece. Only nodes within the longest piece of
the newest character can still be left by an edge, so the state is a window of that many nodes. Whenever
the backpointers of all nodes in the window lead through one boundary, nothing to come can change what is before it: those ids
are committed and forgotten. A text of any length is encoded in the memory of its longest unsettled stretch.

Unigram models take the path with the largest sum of scores (ties: the longer last piece). In a BPE model a sum of scores means
nothing; there a node keeps its edge when merging the two last pieces' characters gives these same two
pieces, which leaves one path per node, the library's own result. Characters without a piece become byte
pieces, or the unknown id.

White space opens a piece and some marks only follow others of their kind; before such a character no piece can span, all
paths converge, and each stretch between such places is encoded once per worker and remembered in a bounded memory.

Null texts are empty texts and have no ids. Rows with a null doc_id and repeated rows are encoded like all others. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.encoder import Memory, no_collection

SPACE = "▁"
REMEMBERED = 300_000  # stretches in each half of a worker's memory
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2
NO_PIECE = -1  # the start of a stretch, or a character without a piece
NOWHERE = ({}, None)


class PieceModel:
    """Pieces, scores and ids of a model file, as a tree of characters."""

    def __init__(self, proto: bytes, kind: int | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.kind = kind or model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice of pieces")
        kinds = model.SentencePiece
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.scores = [p.score for p in model.pieces]
        self.ranks = {p: s for p, (_, s) in normal.items()}
        self.longest = max(map(len, normal), default=1)
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.unknown_score = min(self.ranks.values(), default=0.0) - UNKNOWN_PENALTY
        bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = bytes_of if len(bytes_of) == 256 else None
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.text_of = [p.piece if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else "" for p in model.pieces]
        self.text_of[self.unknown] = " ⁇ "
        self.byte_of = {i: b for b, i in bytes_of.items()}
        self.tree = self._grown(self.ids)
        self.histories: dict[int, list | None] = {}
        self.openers = self._openers(normal)
        marks = re.escape("".join(sorted(self.openers - {SPACE})))
        alone = all(a == SPACE for p in normal for a, b in zip(p, p[1:]) if b == SPACE)
        self.cuts = bool(alone and marks)
        if self.cuts:  # spaces also open a piece after marks
            common = "".join(c for c in ",.;:!?\n" if c in self.openers)
            plain = f"{SPACE}?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[{SPACE}{re.escape(common)}])|"  # the usual case, which the rest would find as well
            self.stretches = re.compile(f"{plain}{SPACE}*[{marks}]*[^{marks}{SPACE}]+|{SPACE}*[{marks}]+|{SPACE}+")
        else:
            self.stretches = re.compile(r"(?s:.+)")

    @staticmethod
    def _grown(ids: dict[str, int]) -> dict:
        """Character -> (the tree below it, the id of the piece that ends there or None)."""
        tree: dict = {}
        for piece in sorted(ids, key=len):
            node = tree
            for ch in piece[:-1]:
                node = node.setdefault(ch, ({}, None))[0]
            node[piece[-1]] = (node.get(piece[-1], ({}, None))[0], ids[piece])
        return tree

    @staticmethod
    def _openers(pieces: Iterable[str]) -> set[str]:
        """Characters that in no piece follow a character outside this set, so that none spans the place before them."""
        pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
        found = {ch for p in pieces for ch in p if not ch.isalnum()}
        while bad := {b for a, b in pairs if b in found and a not in found}:
            found -= bad
        return found

    def spelled(self, ch: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte_ids[b] for b in ch.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def merged(self, symbols: list[str], history: list | None = None) -> list[str]:
        """Byte-pair merging of adjacent symbols: the best score first, then the leftmost. ``history`` gets score, first and last symbol before each merge."""
        while True:
            best = max(
                ((self.ranks[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.ranks), default=None
            )
            if best is None:
                return symbols
            if history is not None:
                history.append((best[0], symbols[0], symbols[-1]))
            i = -best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]

    def history(self, piece: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, ended by one of no score; None where they don't make it."""
        if piece not in self.histories:
            text, found = self.text_of[piece], []
            whole = self.merged(list(text), found) == [text]
            self.histories[piece] = [*found, (-math.inf, text, text)] if whole else None
        return self.histories[piece]

    def stays_apart(self, before: int, piece: int) -> bool:
        """Whether merging the characters of two neighbours gives the same two.

        Each goes through its own merges, as in :meth:`merged`, unless a merge of the symbols at their border is due first.
        """
        left, right = self.history(before), self.history(piece)
        if left is None or right is None:
            return False
        ranks, i, j, end, seam = self.ranks, 0, 0, "", ""
        due = None
        while True:
            a, b = left[i], right[j]
            if a[2] != end or b[1] != seam:
                end, seam = a[2], b[1]
                due = ranks.get(end + seam)
            # Of equal scores the leftmost goes first.
            if due is not None and due > a[0] and due >= b[0]:
                return False
            if a[0] >= b[0]:
                if a[0] == -math.inf:
                    return True
                i += 1
            else:
                j += 1


class StreamingViterbi:
    """``feed`` characters and get ids as soon as they are certain; ``finish`` gives the rest.

    ``most_pending`` is the longest stretch that was ever held back. ``fits`` remembers which pieces may
    follow which, and may be shared between streams.
    """

    def __init__(self, model: PieceModel, fits: dict[int, dict[int, bool]] | None = None):
        self.model, self.fits = model, {} if fits is None else fits
        # Per boundary not yet committed: the best score, the last piece (None: no path), and where that begins.
        self.text, self.most_pending = "", 0
        self.score: list[float] = [0.0]
        self.last: list[int | None] = [NO_PIECE]
        self.back = [0]
        self.walks: list[tuple[int, dict]] = []  # pieces begun and not ended: where, and the place in the tree

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for ch in chars:
            self._step(ch)
            if len(self.text) >= 2 * self.model.longest:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        """The ids left; what is fed next begins a new text."""
        found = self._take(len(self.text))
        self.score, self.last, self.back, self.walks = [0.0], [NO_PIECE], [0], []
        return found

    def _step(self, ch: str) -> None:
        model, unigram = self.model, self.model.kind == UNIGRAM
        begin = len(self.text)
        self.text += ch
        score, last, back = 0.0, None, 0
        if self.last[begin] is not None:
            self.walks.append((begin, model.tree))
        walks = []
        for start, node in self.walks:
            found = node.get(ch)
            if found is None:
                continue
            node, piece = found
            walks.append((start, node))
            if piece is None:
                continue
            if unigram:
                total = self.score[start] + model.scores[piece]
                if last is None or total > score:
                    score, last, back = total, piece, start
            elif last is None and self._fits(self.last[start], piece):
                last, back = piece, start
        self.walks = walks
        if self.last[begin] is not None and model.tree.get(ch, NOWHERE)[1] is None:
            total = self.score[begin] + model.unknown_score  # an edge for the character itself
            if last is None or unigram and total > score:
                score, last, back = total, NO_PIECE, begin
        self.score.append(score)
        self.last.append(last)
        self.back.append(back)

    def whole(self, chars: str) -> list[int]:
        """``feed`` and ``finish`` in one for a text within the window: each node's edges are followed forward at once."""
        last, back = (self._best_sums if self.model.kind == UNIGRAM else self._fitting)(chars)
        found, n = [], len(chars)
        while n:
            piece = last[n]
            found.append(piece if piece != NO_PIECE else chars[back[n] : n])
            n = back[n]
        found.reverse()
        if any(isinstance(x, str) for x in found):
            return [i for x in found for i in (self.model.spelled(x) if isinstance(x, str) else [x])]
        return found

    def _fitting(self, chars: str) -> tuple[list, list[int]]:
        tree, follow, n = self.model.tree, self.fits, len(chars)
        last, back = [None] * (n + 1), [0] * (n + 1)
        last[0] = NO_PIECE
        for start in range(n):
            before = last[start]
            if before is None:
                continue
            may = follow.get(before) or follow.setdefault(before, {})
            node, end = tree, start
            for ch in chars[start:]:
                found = node.get(ch)
                if found is None:
                    break
                end += 1
                node, piece = found
                if piece is not None and last[end] is None:
                    fit = may.get(piece)
                    if self._fits(before, piece) if fit is None else fit:
                        last[end], back[end] = piece, start
            if last[start + 1] is None and tree.get(chars[start], NOWHERE)[1] is None:
                last[start + 1], back[start + 1] = NO_PIECE, start
        return last, back

    def _best_sums(self, chars: str) -> tuple[list, list[int]]:
        tree, scores, n = self.model.tree, self.model.scores, len(chars)
        score, last, back = [0.0] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        last[0] = NO_PIECE
        for start in range(n):
            if last[start] is None:
                continue
            here, node, end = score[start], tree, start
            for ch in chars[start:]:
                found = node.get(ch)
                if found is None:
                    break
                end += 1
                node, piece = found
                if piece is not None and (last[end] is None or here + scores[piece] > score[end]):
                    score[end], last[end], back[end] = here + scores[piece], piece, start
            end = start + 1
            if tree.get(chars[start], NOWHERE)[1] is None and (last[end] is None or here + self.model.unknown_score > score[end]):
                score[end], last[end], back[end] = here + self.model.unknown_score, NO_PIECE, start
        return last, back

    def _fits(self, before: int, piece: int) -> bool:
        """Whether merging the characters of two neighbours gives the same two."""
        row = self.fits.get(before)
        if row is None:
            row = self.fits[before] = {}
        known = row.get(piece)
        if known is None:
            known = row[piece] = self.model.stays_apart(before, piece) if before != NO_PIECE else self.model.history(piece) is not None
        return known

    def _commit(self) -> list[int]:
        """Ids before the last boundary that all backpointers of the window lead through."""
        size = len(self.text)
        alive = {e for e in range(size - self.model.longest + 1, size + 1) if self.last[e] is not None}
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(self.back[far])
        self.most_pending = max(self.most_pending, size)
        return self._take(alive.pop())

    def _take(self, at: int) -> list[int]:
        parts, end = [], at
        while end > 0:
            begin, piece = self.back[end], self.last[end]
            parts.append([piece] if piece != NO_PIECE else self.model.spelled(self.text[begin:end]))
            end = begin
        self.text, self.score, self.last, self.back = self.text[at:], self.score[at:], self.last[at:], [b - at for b in self.back[at:]]
        self.walks = [(s - at, n) for s, n in self.walks]
        return [i for part in reversed(parts) for i in part]


class Lattice:
    """Ids of many short stretches at once: the nodes of all of them, place by place, in numpy.

    The tree of pieces is a hash table of (node, character) -> node. Which pieces may follow which is kept in a table of fixed size,
    whose entries give way to others and are then found in ``fits`` again.
    """

    SLOTS = 1 << 21

    def __init__(self, model: PieceModel, fits: dict[int, dict[int, bool]], stream: StreamingViterbi):
        self.model, self.fits, self.stream = model, fits, stream
        letters = sorted({ord(c) for p in model.ids for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.n_letters = len(letters) + 1
        edges, ends, queue = [], [NO_PIECE], [(0, model.tree)]
        for at, below in queue:
            for ch, (child, piece) in below.items():
                edges.append((at * self.n_letters + int(self.letter[ord(ch)]), len(ends)))
                queue.append((len(ends), child))
                ends.append(NO_PIECE if piece is None else piece)
        self.ends = np.array(ends, np.int32)
        self.single = np.zeros(self.n_letters, bool)
        self.single[[self.letter[ord(p)] for p in model.ids if len(p) == 1]] = True
        self.scores = np.array([model.scores[e] if e != NO_PIECE else 0.0 for e in ends])
        self._hash(np.array(edges, np.int64).reshape(-1, 2))
        self.known = np.full(self.SLOTS, -1, np.int64)  # twice the pair, and one where it fits

    def _hash(self, edges: np.ndarray) -> None:
        self.bits = max(int(len(edges) * 4).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        probe, left = 0, edges
        while len(left):
            slots = self._slot(left[:, 0], self.bits) + probe & (1 << self.bits) - 1
            free = np.flatnonzero(self.keys[slots] == -1)
            _, first = np.unique(slots[free], return_index=True)
            taken = free[first]
            self.keys[slots[taken]], self.values[slots[taken]] = left[taken, 0], left[taken, 1]
            left = np.delete(left, taken, axis=0)
            probe += 1

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _below(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node below each node by a letter, 0 where there is none."""
        keys = nodes * np.int64(self.n_letters) + letters
        slots, mask = self._slot(keys, self.bits), (1 << self.bits) - 1
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], 0)
        others = np.flatnonzero((held != keys) & (held != -1))
        slots = slots[others]
        while len(others):  # an empty slot ends the search
            slots = slots + 1 & mask
            held = self.keys[slots]
            hit = held == keys[others]
            found[others[hit]] = self.values[slots[hit]]
            going = ~hit & (held != -1)
            others, slots = others[going], slots[going]
        return found

    def _fit(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        pairs = (before.astype(np.int64) + 1) * len(self.model.scores) + pieces
        slots = self._slot(pairs, self.SLOTS.bit_length() - 1)
        held = self.known[slots]
        missing = np.flatnonzero(held >> 1 != pairs)
        if len(missing):
            wanted, back = np.unique(pairs[missing], return_inverse=True)
            first, second = np.divmod(wanted, len(self.model.scores))
            fits = np.array([self.stream._fits(a - 1, b) for a, b in zip(first.tolist(), second.tolist())], np.int64)
            coded = wanted * 2 + fits
            held[missing] = coded[back]
            self.known[slots[missing]] = held[missing]
        return (held & 1).astype(bool)

    def encode(self, stretches: list[str]) -> list[bytes]:
        """Coded ids of stretches of one length."""
        m, size, unigram = len(stretches), len(stretches[0]), self.model.kind == UNIGRAM
        points = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.ascontiguousarray(self.letter[points].reshape(m, size).T)
        last = np.full((size + 1, m), -2, np.int32)  # -2: no path
        back = np.zeros((size + 1, m), np.int8)
        score = np.zeros((size + 1, m)) if unigram else None
        last[0] = NO_PIECE
        for start in range(size):
            rows = np.flatnonzero(last[start] != -2)
            strange = rows[~self.single[letters[start, rows]]]  # an edge for the character itself
            if unigram:
                total = score[start, strange] + self.model.unknown_score
                strange = strange[(last[start + 1, strange] == -2) | (total > score[start + 1, strange])]
                score[start + 1, strange] = score[start, strange] + self.model.unknown_score
            else:
                strange = strange[last[start + 1, strange] == -2]
            last[start + 1, strange], back[start + 1, strange] = NO_PIECE, start
            nodes = np.zeros(len(rows), np.int64)
            before = last[start, rows]
            for end in range(start + 1, min(size, start + self.model.longest) + 1):
                nodes = self._below(nodes, letters[end - 1, rows])
                going = np.flatnonzero(nodes)
                if len(going) < len(rows):
                    rows, nodes, before = rows[going], nodes[going], before[going]
                if not len(rows):
                    break
                pieces = self.ends[nodes]
                chosen = np.flatnonzero(pieces != NO_PIECE)
                if unigram:
                    total = score[start, rows[chosen]] + self.scores[nodes[chosen]]
                    chosen = chosen[(last[end, rows[chosen]] == -2) | (total > score[end, rows[chosen]])]
                    score[end, rows[chosen]] = score[start, rows[chosen]] + self.scores[nodes[chosen]]
                else:
                    chosen = chosen[last[end, rows[chosen]] == -2]
                    chosen = chosen[self._fit(before[chosen], pieces[chosen])]
                last[end, rows[chosen]] = pieces[chosen]
                back[end, rows[chosen]] = start
        out = np.zeros((m, size), np.int32)
        at, place = np.full(m, size), np.full(m, size)
        while len(rows := np.flatnonzero(at)):
            place[rows] -= 1
            pieces, begin = last[at[rows], rows], back[at[rows], rows]
            out[rows, place[rows]] = np.where(pieces == NO_PIECE, -1 - begin, pieces)
            at[rows] = begin
        raw, width = out.astype(self.model.dtype).tobytes(), size * self.model.dtype.itemsize
        begins = place * self.model.dtype.itemsize
        coded = [raw[i * width + b : (i + 1) * width] for i, b in enumerate(begins.tolist())]
        for i in np.flatnonzero((out < 0).any(axis=1)).tolist():
            spelled = [x for p in out[i, place[i] :].tolist() for x in ([p] if p >= 0 else self.model.spelled(stretches[i][-1 - p]))]
            coded[i] = np.array(spelled, self.model.dtype).tobytes()
        return coded


class PieceEncoder:
    """Whole texts by stretches that no piece spans, with a bounded memory of stretches.

    Texts go in by windows of about ``WINDOW`` characters. The stretches of a window that are not remembered are encoded together.
    """

    WINDOW = 1 << 21

    def __init__(self, model: PieceModel):
        self.model = model
        self.stream = StreamingViterbi(model)
        self.lattice = Lattice(model, self.stream.fits, self.stream)
        self.fresh: dict[str, bytes] = {}
        self.seen = Memory(self._stretch, REMEMBERED)
        self.coded = [i.to_bytes(model.dtype.itemsize, "little") for i in range(len(model.text_of))]

    def _stretch(self, chars: str) -> bytes:
        known = self.fresh.get(chars)
        if known is not None:
            return known
        # What fits into the window has nothing to commit before its end.
        stream = self.stream
        found = stream.whole(chars) if len(chars) < 2 * self.model.longest else stream.feed(chars) + stream.finish()
        coded = self.coded
        return b"".join([coded[i] for i in found])

    def _learn(self, stretches: set[str]) -> None:
        self.fresh = {}
        by_length: dict[int, list[str]] = {}
        for s in stretches:
            if len(s) < 2 * self.model.longest:
                by_length.setdefault(len(s), []).append(s)
        for alike in by_length.values():
            if len(alike) >= 16:  # for fewer, one by one is as quick
                self.fresh.update((s, ids) for s, ids in zip(alike, self.lattice.encode(alike)))

    def _windows(self, texts: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
        """(number of the text, normalised part), cut before white space, in lists of about ``WINDOW`` characters; an empty text is one empty part."""
        held, size = [], 0
        for k, text in enumerate(texts):
            normal, at = self.model.processor.normalize(text) if text else "", 0
            while True:
                cut = normal.find(SPACE, at + self.WINDOW - size)
                while cut > 0 and normal[cut - 1] == SPACE:
                    cut = normal.find(SPACE, cut + 1)
                if cut < 0 or not self.model.cuts:
                    cut = len(normal)
                held.append((k, normal[at:cut]))
                size, at = size + cut - at, cut
                if size >= self.WINDOW:
                    yield held
                    held, size = [], 0
                if at >= len(normal):
                    break
        if held:
            yield held

    def encode_each(self, texts: Iterable[str]) -> list[bytes]:
        """Coded ids of each text."""
        out, seen = [], self.seen
        for window in self._windows(texts):
            parts = [self.model.stretches.findall(part) for _, part in window]
            self._learn(set().union(*parts).difference(seen, seen.older))
            for (k, _), stretches in zip(window, parts):
                ids = b"".join([seen[s] for s in stretches])
                if k < len(out):
                    out[k] += ids
                else:
                    out.append(ids)
        self.fresh = {}
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_each([text])[0], dtype=self.model.dtype)


def decode(model: PieceModel, ids: Iterable[int]) -> str:
    """Text of ids: byte pieces joined to characters (broken ones as U+FFFD), the marks of spaces turned to spaces."""
    ids = list(ids)
    if model.byte_of.keys().isdisjoint(ids):
        text = "".join(map(model.text_of.__getitem__, ids))
    else:
        parts, run = [], bytearray()
        for i in [*ids, None]:
            if i in model.byte_of:
                run.append(model.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i is not None:
                parts.append(model.text_of[i])
        text = "".join(parts)
    text = text.replace(SPACE, " ")
    return text[1:] if model.prefix and text.startswith(" ") else text


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker and model file."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = PieceEncoder(PieceModel(f.read()))
    return _encoders[path]


def _typed(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ids) and the columns to ``keep``; ids as little-endian BINARY of 2 or 4 bytes each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    carried = ("doc_id", *keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model_path)
        for batch in batches:
            with no_collection():
                ids = enc.encode_each(t.as_py() or "" for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(ids, pa.binary())], names=[*carried, "ids"])

    return rows.mapInArrow(encode, f"{_typed(rows, carried)}ids binary")


def decode_pieces(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text, n_ids, ids_crc32) and the columns to ``keep``; the checksum is over 4-byte little-endian ids."""
    carried = ("doc_id", *keep)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(model_path).model
        for batch in batches:
            rows = [np.frombuffer(raw.as_py(), dtype=model.dtype) for raw in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, carried),
                    pa.array([decode(model, ids.tolist()) for ids in rows], pa.string()),
                    pa.array([len(ids) for ids in rows], pa.int64()),
                    pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in rows], pa.int64()),
                ],
                names=[*carried, "text", "n_ids", "ids_crc32"],
            )

    return encoded.mapInArrow(back, f"{_typed(encoded, carried)}text string, n_ids long, ids_crc32 long")
