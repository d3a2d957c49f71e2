"""The training-text operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from notewright.llm import capfilters, common, components, exactdedup, importance, licenses, packing, pieces, pii, sharding, simhash, tokenbin
from notewright.llm.encoder import Encoder
from notewright.session import stage as written

VOCABULARY, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, count long, kept string"  # two columns named like results
AWKWARD = [
    (1, "alpha beta gamma delta", 1, "x"), (2, "alpha beta gamma delta", 2, None), (3, None, None, "y"), (4, "", 3, "z"),
    (5, "long " * 30_000 + "end", 4, "x"), (6, "Ünïcode 😀 text\n\nwith lines", 5, "x"), (7, "alpha beta gamma delta epsilon", 6, "x"),
    (8, "twice", 7, "x"), (8, "twice", 7, "x"), (None, "without an id", 8, "x"), (10, " \t\n ", 9, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df):
    return [r.asDict() for r in df.collect()]


def test_kth_largest(spark):
    values = [random.Random(1).randrange(-(10**12), 10**12) for _ in range(300)] + [5] * 20
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 150, 320):
        assert common.kth_largest(df, "x", k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df, "x", 321) is None and common.kth_largest(df.limit(0), "x", 1) is None


def test_without_ids(spark, docs):
    left = common.without_ids(docs, spark.createDataFrame([(8,), (1,), (99,)], "doc_id long"))
    assert sorted(str(r["doc_id"]) for r in table(left)) == sorted(["2", "3", "4", "5", "6", "7", "None", "10"])
    assert left.columns == docs.columns


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    label = components.star_links(1300, *np.array(links).T)
    got = {r["node"]: r["root"] for r in table(components.connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {n: int(label[n]) for a, b in links if a != b for n in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(docs, empty):
    texts = [(i, t or "") for i, t, *_ in AWKWARD]
    for r in table(exactdedup.exact_groups(docs, hash_all=True)):
        mine = [j for j, t in texts if hashlib.sha256(t.encode()).hexdigest() == r["full_hash"]]
        assert r["group_size"] == len(mine) and r["keep_id"] == max((j for j in mine if j is not None), default=None)
    rows = table(exactdedup.exact_groups(docs))
    assert len(rows) == len(AWKWARD) and sum(r["kept"] for r in rows) == len({t for _, t in texts})
    left = exactdedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in table(left)) == sorted(map(str, (2, 4, 5, 6, 7, 8, None, 10)))
    assert exactdedup.exact_groups(empty).count() == 0 and exactdedup.drop_copies(empty).count() == 0


def test_minimax_cuts_equal_dynamic_programme(spark):
    rnd = random.Random(3)
    for shards, n, fences in ((4, 60, 128), (3, 25, 72), (16, 10, 2048)):
        sizes = [rnd.choice((1, 2, 5, 40, 300)) * 1000 + rnd.randrange(999) for _ in range(n)]
        ends = np.cumsum(sizes).tolist()
        best = {0: 0}
        for _ in range(shards):  # end reached -> the smallest largest shard
            best = {e: min(max(c, e - s) for s, c in best.items() if s <= e) for e in [0, *ends]}
        cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long").coalesce(1), shards, fences)
        assert max(np.diff([0, *cuts])) == best[ends[-1]] and cuts[-1] == ends[-1] and set(cuts) <= {0, *ends}


def test_shards(docs, empty):
    rows = table(sharding.shard_documents(docs, 4))
    assert len(rows) == len(AWKWARD)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = {str(i): len((t or "").encode()) + 1 for i, t, *_ in AWKWARD}
    assert all(r["size"] == sizes[str(r["doc_id"])] for r in rows)
    by_text = {}
    for i, t, *_ in AWKWARD:
        by_text.setdefault(t or "", set()).update(r["shard"] for r in rows if r["doc_id"] == i and r["text_crc32"] == zlib.crc32((t or "").encode()))
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard_documents(empty, 4).count() == 0


def test_encoder_equals_the_library():
    rnd, ours, theirs = random.Random(4), Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    theirs.encode_special_tokens = True
    for _ in range(4000):
        text = "".join(rnd.choice(" \n\t'sA1é日́\x1c\x85 .,-_ªµß😀tredo<|endoftext|>") for _ in range(rnd.randint(0, 30)))
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_names_of_added_tokens_are_those_tokens():
    ours, theirs = Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "a <|endoftext b|>"):
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert 50256 in ours.encode("a <|endoftext|> b")


def test_elias_fano():
    for n, top in ((0, 1), (1, 10**12), (700, 50), (3000, 10**9)):
        values = np.sort(np.random.default_rng(n).integers(0, top, n))
        made = tokenbin.EliasFano.encode(values)
        back = tokenbin.EliasFano.from_bytes(made.to_bytes())
        assert back.values().tolist() == values.tolist() == [back.select(i) for i in range(n)]
    assert len(tokenbin.EliasFano.encode(np.arange(0, 10**6, 500)).to_bytes()) < 2000 * 8 / 4
    with pytest.raises(IndexError):
        back.select(n)


def ids_of(text):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(tokenbin, "SEGMENT_TOKENS", 40)
    path = tokenbin.write_token_files(docs, VOCABULARY)
    segments = tokenbin.read_token_files(spark, path)
    rows = sorted(table(tokenbin.document_index(segments, 2)), key=lambda r: r["start"])
    want, at = sorted(((i, t or "") for i, t, *_ in AWKWARD), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = ids_of(t)
        assert r == {"doc_id": i, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)
    first = tokenbin.Segment(segments.orderBy("start").first().asDict(), 2)
    assert first.document(0).tolist() == ids_of(want[0][1]).tolist()
    assert tokenbin.document_index(tokenbin.read_token_files(spark, tokenbin.write_token_files(empty, VOCABULARY)), 2).count() == 0


def test_packing(docs, empty):
    rows = table(packing.pack(docs, VOCABULARY, window=64))
    ids = {(i, zlib.crc32(ids_of(t).tobytes())): ids_of(t) for i, t, *_ in AWKWARD}
    total = sum(len(ids_of(t)) for _, t, *_ in AWKWARD)
    assert sum(r["length"] for r in rows) == total
    for r in rows:
        assert any(i == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for (i, _), x in ids.items())
    by_window = {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_window.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, [*places[1:], (sum(places[-1]), 0)])) and sum(places[-1]) <= 64
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_packing_plan_uses_everything_once():
    rnd = np.random.default_rng(6)
    for draw in (rnd.integers(1, 1025, 50_000), np.full(999, 600), rnd.integers(1, 5, 100), np.array([], dtype=int)):
        counts = np.bincount(draw, minlength=1025)
        patterns = packing.plan({i: int(c) for i, c in enumerate(counts) if c}, 1024)
        used = np.zeros(1025, dtype=int)
        for lengths, times in patterns:
            assert sum(lengths) <= 1024 and times > 0
            np.add.at(used, lengths, times)
        assert (used == counts).all()
        if len(draw) == 50_000:
            assert draw.sum() / (1024 * sum(k for _, k in patterns)) > 0.99


def test_fingerprint_and_groups(spark, docs, empty):
    rows = table(simhash.near_groups(docs))
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], r)
    assert by_id[3]["fp"] == by_id[4]["fp"] == by_id[10]["fp"] == bytes(8) and by_id[10]["component_id"] == 3
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == 1 and len(rows) == len(AWKWARD)
    one = spark.sql("select xxhash64('a b c') h").first()["h"]  # the hash of the contract, seed 42
    assert simhash.fingerprint("A\tb  C", 3) == ((one & (1 << 64) - 1).to_bytes(8, "big"), 1)
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near(empty).count() == 0


def test_links_equal_brute_force(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(3))) & (1 << 64) - 1 for b in base for _ in range(6)})
    df = spark.createDataFrame([(f.to_bytes(8, "big"), 1, i) for i, f in enumerate(fps)], "fp binary, size long, node long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components.star_links(len(fps), *np.array(links).T)
    for block in (8, 2048):
        found = [(r["a"], r["b"]) for r in table(simhash.fingerprint_links(df, 2, block=block))]
        assert (components.star_links(len(fps), *np.array(found).T) == want).all()


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, text(300)) for i in range(40)]
    copies = [(100 + i, t.replace(t.split()[50], "other", 1)) for i, t in rows[:10]]
    left = simhash.drop_near(spark.createDataFrame(rows + copies, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in table(left)) == list(range(40))


def pair_at(rnd, jaccard, n, word):
    """Two texts of ``n`` words with different words at the start of one, so that the five-word shingle sets have about that similarity."""
    shared = round(2 * jaccard * (n - 4) / (1 + jaccard))
    tail = [word() for _ in range(shared + 4)]
    return [" ".join([word() for _ in range(n - len(tail))] + tail) for _ in range(2)]


def brute_groups(texts, similarity=0.8):
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return components.star_links(len(sets), *np.array(links, dtype=int).reshape(-1, 2).T)


def test_near_copies_have_the_jaccard_similarity(spark):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    texts = [t for jaccard in (0.6, 0.75, 0.79, 0.81, 0.85) for n in (60, 200, 600) for _ in range(6) for t in pair_at(rnd, jaccard, n, word)]
    common_half = " ".join(word() for _ in range(140))  # distinct texts that share a passage of more than half their length
    texts += [f"{' '.join(word() for _ in range(60))} {common_half}" for _ in range(40)]
    lines = [" ".join(word() for _ in range(9)) for _ in range(12)]
    texts += [" ".join(lines), " ".join(lines * 5)]  # repeats change counts but hardly the set
    texts += [" ".join(word() for _ in range(9)) for _ in range(30)]
    texts += [f"{t} {word()}" for t in texts[-30:]]  # sets of 5 and 6 shingles
    rnd.shuffle(texts)
    label = brute_groups(texts)
    left = simhash.drop_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in table(left)) == sorted(set(label.tolist()))


def test_large_groups_are_checked_by_blocks(spark):
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(80)]
    texts = [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(0, 80, 3)] + [" ".join(base[:40] + [word() for _ in range(40)]) for _ in range(20)]
    made = [simhash.set_fingerprint(t, 5, 4) for t in texts]
    df = spark.createDataFrame([(i, 0, fp, n, len(t), t) for i, (t, (fp, n, _)) in enumerate(zip(texts, made))], "node long, root long, fp binary, size long, n_bytes long, text string")
    for block, block_bytes in ((6, 1 << 20), (512, 3000), (512, 1 << 20)):
        found = [(r["a"], r["b"]) for r in table(simhash.jaccard_links(df, 5, 0.8, 256, 4, block, block_bytes))]
        assert (components.star_links(len(texts), *np.array(found).T) == brute_groups(texts)).all()


def test_importance_keeps_target_text(spark, empty):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice("the of river stone walked slowly home light and".split()) for _ in range(60))
    junk = lambda: " ".join(rnd.choice("BUY!! $$$ click%% ### win*** now!!".split()) for _ in range(60))
    rows = [(i, good() if i % 4 else junk(), i, "x") for i in range(200)] + [(None, good(), 0, "x"), (300, None, 0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(120)] + [(None, 1), (5, None), (999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in table(importance.resample(docs, labels))}
    assert len(out) == len(rows) and all(out[i]["kept"] == (i % 4 > 0) for i in range(200))
    assert out[300]["n_grams"] == 0 and out[300]["log_weight"] == 0
    again = {r["doc_id"]: r["key"] for r in table(importance.resample(docs.repartition(7), labels))}
    assert all(abs(again[i] - out[i]["key"]) < 1e-3 for i in again)
    assert importance.keep_good(docs, labels).columns == docs.columns
    assert importance.resample(docs, labels.limit(0)).filter("kept").count() == len(rows)
    assert importance.resample(empty, labels).count() == 0


def brute_spans(text):
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return pii.in_order(found)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(10)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1@.-+ ()%2_\n") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_rows())


def test_field_on_held_out_rows(field):
    right = wrong = 0
    for text, spans in pii.labelled_rows(200, seed=99):
        b, labels = field.decode([text])
        gold = pii._gold([(text, spans)], b)
        right, wrong = right + int(((labels == gold) & (gold > 0)).sum()), wrong + int((labels != gold).sum())
    assert right / (right + wrong) > 0.9


def test_closed_tokens_change_nothing(field):
    texts = [t for t, _ in pii.labelled_rows(150, seed=5)] + ["", "  ", "plain words only " * 50]
    b, features = field.features(texts)
    emit = sum(t[f] for t, f in zip(field.tables, features))
    edge = np.searchsorted(b.doc, np.arange(len(texts) + 1))
    some = edge[1:] > edge[:-1]
    assert (pii.viterbi(emit, edge[:-1][some], edge[1:][some], field.steps) == field.decode(texts)[1]).all()


def test_spans_and_redaction(spark, docs, empty, field):
    text = "call (672) 555-8657 or mail é.a@b.org from 1.2.3.4"
    df = spark.createDataFrame([(1, text, 1, "x"), (2, None, 1, "y")], DOCS)
    first = next(r for r in table(pii.find_spans(df, field)) if r["doc_id"] == 1)
    assert [text[s.start : s.stop] for s in first["base"]] == [".a@b.org", "1.2.3.4"]
    assert [text[s.start : s.stop] for s in first["added"]] == ["(672) 555-8657"]
    assert {r["doc_id"]: (r["text"], r["kept"]) for r in table(pii.redact(df, field))} == {1: ("call <PHONE> or mail é<EMAIL> from <IP>", "x"), 2: (None, "y")}
    assert pii.find_spans(docs, field).count() == len(AWKWARD) and pii.find_spans(empty, field).count() == pii.redact(empty, field).count() == 0


def test_pieces_equal_the_library(docs, empty):
    with open(PIECES, "rb") as f:
        proto = f.read()
    model, theirs, rnd = pieces.PieceModel(proto), SentencePieceProcessor(model_proto=proto), random.Random(11)
    ours = pieces.PieceEncoder(model)
    texts = ["", "  Hello   wörld\n a\tb ", "日本語の😀\x00é", "x▁y", "a" * 300] + ["".join(rnd.choice("ab  ,.the\nñ😀1") for _ in range(rnd.randint(1, 60))) for _ in range(800)]
    for t in texts:
        ids = ours.encode(t).tolist()
        assert ids == theirs.encode(t) and pieces.decode(model, ids) == theirs.decode(ids)
    back = table(pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES))
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in AWKWARD)
    assert pieces.encode_pieces(empty, PIECES).count() == 0


@pytest.mark.parametrize("kind", (pieces.BPE, pieces.UNIGRAM))
def test_lattice_of_many_stretches_equals_the_stream(kind):
    with open(PIECES, "rb") as f:
        model = pieces.PieceModel(f.read(), kind=kind)
    rnd = random.Random(13)
    ours, stream = pieces.PieceEncoder(model), pieces.StreamingViterbi(model)
    for size in (1, 2, 5, 12, 31):
        many = ["".join(rnd.choice("▁abthein,ñ😀日") for _ in range(size)) for _ in range(300)]
        coded = [np.frombuffer(x, model.dtype).tolist() for x in ours.lattice.encode(many)]
        assert coded == [stream.feed(x) + stream.finish() for x in many]
    if kind == pieces.BPE:
        for a, b in ((rnd.randrange(3, len(model.text_of)), rnd.randrange(3, len(model.text_of))) for _ in range(2000)):
            pair = [model.text_of[a], model.text_of[b]]
            assert not all(pair) or model.stays_apart(a, b) == (model.merged(list("".join(pair))) == pair)


def test_windows_of_a_text_give_the_same_ids():
    with open(PIECES, "rb") as f:
        model = pieces.PieceModel(f.read())
    small, text = pieces.PieceEncoder(model), "the  theanttion, end.\n ünd so   on " * 40
    small.WINDOW = 50
    for texts in (["", text, "x", text[7:], ""], [" " * 300], ["a" * 300]):
        assert [np.frombuffer(x, model.dtype).tolist() for x in small.encode_each(texts)] == model.processor.encode(texts)


def test_many_spans_in_one_text():
    field = pii.train([(t, [tuple(s) for s in spans]) for t, spans in pii.labelled_rows()])
    one = "é (672) 555-8657 or 10.0.0.1, ask ab.cd@mail.example.com. "
    (base, added), (base_many, added_many) = pii.all_spans([one, one * 400], field)
    assert added and [(x % len(one), y - x, k) for x, y, k in added_many].count((added[0][0], added[0][1] - added[0][0], added[0][2])) >= 398
    assert all(e <= x or y <= s for x, y, _ in added_many for s, e, _ in base_many if abs(s - x) < 100)


def test_streams_commit_within_a_window():
    with open(PIECES, "rb") as f:
        model = pieces.PieceModel(f.read())
    for text in ("the theanttion " * 300, "ab" * 1500):
        normal, stream, ids = model.processor.normalize(text), pieces.StreamingViterbi(model), []
        for i in range(0, len(normal), 7):
            ids += stream.feed(normal[i : i + 7])
        assert ids + stream.finish() == model.processor.encode(text) and stream.most_pending <= 3 * model.longest


def test_unigram_equals_brute_force():
    with open(PIECES, "rb") as f:
        model = pieces.PieceModel(f.read(), kind=pieces.UNIGRAM)
    rnd = random.Random(12)
    for _ in range(200):
        chars = "".join(rnd.choice("▁abthe,ñ😀") for _ in range(rnd.randint(1, 45)))
        best = [(0.0, [])] + [None] * len(chars)
        for i in range(1, len(chars) + 1):
            for j in range(max(0, i - model.longest), i):
                piece = chars[j:i]
                score = model.ranks.get(piece, model.unknown_score if i - j == 1 else None)
                if score is not None and best[j] and (best[i] is None or best[j][0] + score > best[i][0]):
                    best[i] = best[j][0] + score, best[j][1] + ([model.ids[piece]] if piece in model.ids else model.spelled(piece))
        stream = pieces.StreamingViterbi(model)
        assert stream.feed(chars) + stream.finish() == best[-1][1] == pieces.StreamingViterbi(model).whole(chars)


def test_licences(spark, docs, empty):
    model = licenses.fit(licenses.labelled_table(spark))
    assert model.held_out_accuracy > 0.9
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose", 0, "x"), (2, "licensed under cc by-sa 3.0", 0, "x"), (3, "He lost his driving license yesterday.", 0, "x"),
        (4, "Licensed under the Foobar Public Accord.", 0, "x"), (5, "nothing here", 0, "x"), (6, None, 0, "x"), (None, "All rights reserved.", 0, "x"),
    ]
    found = {r["doc_id"]: (r["place"], r["family"]) for r in table(licenses.scan_licenses(spark.createDataFrame(rows, DOCS), model))}
    assert found == {1: (1, "mit"), 2: (0, "cc-by-sa"), 4: (0, "unknown"), None: (0, "all-rights-reserved")}
    plan = licenses.scan_licenses(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan_licenses(empty, model).count() == 0


def test_licences_by_name_and_wrapped(spark):
    model = licenses.fit(licenses.labelled_table(spark))
    wanted = [  # no wording of the templates, or lines wrapped within a name
        ("Released under CC BY-SA 4.0", {"cc-by-sa"}), ("This is distributed under the BSD 3-Clause terms", {"bsd"}), ("MIT", {"mit"}), ("CC0 1.0", {"cc0"}),
        ("You may use it under the terms of the MPL 2.0", {"mpl"}), ("ISC", {"unknown"}), ("WTFPL", {"unknown"}), ("EPL-2.0", {"unknown"}),
        ("Diese Software steht unter einer Lizenz", {"unknown"}), ("Unlicense", {"unknown"}),
        ("// This work is released under the Creative Commons\n// Attribution-ShareAlike 4.0 International\n// Public License", {"cc-by-sa"}),
        ("/*\n * Distributed under the terms of the GNU Affero\n * General Public License\n */", {"agpl"}), ("It is free under the GNU Lesser\nGeneral Public License.", {"lgpl"}),
        ("Code is licensed under the MIT License. Text is available\nunder CC BY 4.0.", {"mit", "cc-by"}),
        ("filler text " * 60 + "\nLicensed under the Apache\nLicense, Version 2.0. " + "other filler " * 60, {"apache"}),
        ("Er ging mit der Frau und mit dem Hund.", set()), ("Plain prose about the river.\n\nAnd the park.", set()),
    ]
    found = {i: set() for i in range(len(wanted))}
    for r in table(licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(wanted)], "doc_id long, text string"), model)):
        found[r["doc_id"]].add(r["family"])
    assert [(wanted[i][0][:60], f) for i, f in found.items()] == [(t[:60], f) for t, f in wanted]
    placed = licenses.scan_licenses(spark.createDataFrame([(1, "a title\n\n# First.\n# All rights reserved.")], "doc_id long, text string"), model)
    assert [(r["paragraph"], r["place"], r["family"]) for r in table(placed)] == [(1, 1, "all-rights-reserved")]


def test_licence_groups_of_known_words(spark):
    vocabulary = ["^", "$", "mit", "license", "mit license", "the mit license", "license $", "^ the", "under the"]
    texts = ["", "--", "The MIT-License", "Er kam mit der Bahn", "under\u00fc the (mit) LICENSE!", "license", "prose without any of them " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, passage string")
    every = {r["i"]: set(r["__g"]) & set(vocabulary) for r in licenses._grams(df).collect()}
    known = {r["i"]: r["__g"] for r in licenses._known_grams(df, vocabulary).collect()}
    assert {i: set(g) & set(vocabulary) for i, g in known.items()} == every
    assert known[6] == ["^", "$"] and None not in known[3]
    placed = licenses.windows(spark.createDataFrame([(1, "a b\n\x0b\nc " + "d " * 60)], "doc_id int, lines string")).orderBy("start").collect()
    assert [(r["start"], r["counted"], len(r["passage"].split())) for r in placed] == [(0, [2, 0, 61], 48), (24, [2, 0, 61], 39)]


def test_near_vectors(spark):
    rnd = np.random.default_rng(13)
    base = rnd.standard_normal((120, 24))
    near = base[:60] + rnd.standard_normal((60, 24)) * 0.02
    rows = [(i, v.tolist(), i % 120 % 3) for i, v in enumerate(np.concatenate([base, near, near[:20]]))]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None, 1.0], 1), (904, base[0].tolist(), None), (None, base[0].tolist(), 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    links = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    part = components.star_links(len(x), *np.nonzero(links))
    schema = "vec_id long, embedding array<double>, label int"
    got = table(capfilters.near_vectors(spark.createDataFrame(rows + odd, schema)))
    by_id = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    found = sum(by_id[i]["n_links"] for i in range(len(x)))
    assert found >= 0.99 * links.sum() and all(by_id[i]["n_links"] <= links[i].sum() for i in range(len(x)))
    if found == links.sum():
        assert all(by_id[i]["component_id"] == part[i] for i in range(len(x)))
    assert by_id[905]["component_id"] == by_id[906]["component_id"] == 905 and not by_id[906]["kept"]
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["component_id"] == i for i in (900, 901, 902, 903, 904, None))
    assert capfilters.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_several_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 4)
    rnd = np.random.default_rng(14)
    x = rnd.standard_normal(16) + rnd.standard_normal((40, 16)) * 0.01
    got = table(capfilters.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")))
    assert all(r["n_links"] == 39 and r["component_id"] == 0 for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


@pytest.mark.parametrize("name", ["op8_cap_filters", "op9_exact_dedup"])
def test_queries_with_sql(spark, name):
    import duckdb

    from notewright.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall())
