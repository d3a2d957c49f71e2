import pytest

from conftest import rows
from notewright.operators import dialogues as D
from notewright.operators import joins as J


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, dialogue string")


def test_assemble_and_split(spark):
    turns = spark.createDataFrame(
        [(7, 1, "patient", "Hi"), (7, 0, "doctor", "Hello"), (8, 0, "doctor", None)],
        "conv_id long, turn long, role string, text string",
    )
    made = D.assemble_dialogues(turns)
    assert rows(made, "id", "dialogue") == [(7, "[doctor]: Hello\n[patient]: Hi"), (8, "[doctor]: ")]
    assert rows(D.split_turns(made)) == [
        (7, 0, "[doctor]: Hello"),
        (7, 1, "[patient]: Hi"),
        (8, 0, "[doctor]:"),
    ]


def test_split_without_markers_uses_lines(spark):
    got = D.split_turns(frame(spark, "one\n\n two \n", "[DOCTOR]: a [Patient]: b", None))
    assert rows(got) == [(0, 0, "one"), (0, 1, "two"), (1, 0, "[DOCTOR]: a"), (1, 1, "[Patient]: b")]


def greedy(turns, limit):
    chunks, current = [], []
    for turn in turns:
        if current and sum(len(t.split()) for t in current) + len(turn.split()) > limit:
            chunks.append(" ".join(current))
            current = []
        current.append(turn)
    if current:
        chunks.append(" ".join(current))
    return [c for c in chunks if len(c.strip()) >= 5]


def test_chunk_turns_packs_greedily(spark):
    lines = [" ".join(["word"] * n) for n in (100, 100, 1, 250, 3, 199, 1, 1)] + ["ab"]
    got = [r["text"] for r in D.chunk_turns(frame(spark, "\n".join(lines))).orderBy("chunk").collect()]
    assert got == greedy(lines, 200)
    assert len(got[0].split()) == 200
    assert rows(D.chunk_turns(frame(spark, "abc"))) == []


def test_chunk_fixed(spark):
    turns = D.split_turns(frame(spark, "a\nb\nc\nd"))
    assert rows(D.chunk_fixed(turns)) == [(0, 0, "a b c"), (0, 1, "d")]


def test_split_is_stable_per_key(spark):
    df = spark.range(2000)
    whole = dict(rows(D.train_eval_split(df)))
    part = dict(rows(D.train_eval_split(df.filter("id % 7 = 3"))))
    assert all(whole[k] == v for k, v in part.items())
    share = sum(v == "train" for v in whole.values()) / 2000
    assert 0.8 < share < 0.9


def test_gates(spark):
    df = spark.createDataFrame([(1, "x", "[]"), (2, " ", "[]"), (3, "x", None)], "id long, a string, b string")
    assert rows(D.drop_blank(df, ["a", "b"]), "id") == [(1,)]
    assert rows(D.blank_counts(df, ["a", "b"])) == [(3, 2)]
    assert rows(D.gate_counts(df, ["a", "b"])) == [(3, "a", 1), (3, "b", 1)]
    with pytest.raises(ValueError, match="required"):
        D.require_complete(df, ["a"])
    assert D.require_complete(df.filter("id = 1"), ["a", "b"]).count() == 1


def test_pairing_and_coverage(spark):
    gold = spark.createDataFrame([(1, "r1"), (2, None), (3, "r3")], "id long, note string")
    sub = spark.createDataFrame([(1, "p1"), (2, "p2"), (2, "p2b"), (9, "p9")], "id long, generated_note string")
    assert rows(J.pair_up(sub, gold)) == [(1, "p1", "r1"), (2, "p2", ""), (2, "p2b", "")]
    r = J.coverage(sub, gold).first()
    assert (r.n_gold, r.n_matched, r.n_missing, r.coverage) == (3, 3, 1, 100.0)
    assert rows(J.missing_ids(sub, gold)) == [(3,)]
    with pytest.raises(ValueError, match="no id"):
        J.require_match(sub.filter("id = 9"), gold)


def test_lookups(spark):
    table = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id long, v string, o long")
    assert rows(J.lookup_left(spark.range(1, 3), table, "id", "v", "o", "none")) == [(1, "b"), (2, "none")]
    own = spark.createDataFrame(
        [(1, " own ", None), (2, " ", "[1]"), (3, None, None)], "id long, retrieved_note string, entities_json string"
    )
    notes = spark.createDataFrame([(1, "c1"), (2, "c2")], "id long, retrieved_note string")
    ents = spark.createDataFrame([(1, "e1")], "id long, entities_json string")
    assert rows(J.resolve_inputs(own, notes, ents), "id", "retrieved_note", "entities_json") == [
        (1, " own ", "e1"),
        (2, "c2", "[1]"),
        (3, "", "{}"),
    ]


def test_merge_report(spark):
    a = spark.createDataFrame([(1, "d", "n", "[]"), (2, "d", "n", "[]")], "id long, dialogue string, note string, entities_json string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "id long, retrieved_note string")
    assert rows(J.merge_reconciled(a, b), "id", "retrieved_note") == [(2, "x")]
    assert rows(J.merge_report(a, b)) == [(2, 2, 1, True)]
