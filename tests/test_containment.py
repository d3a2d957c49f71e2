"""Anchored containment against plain substring tests."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from notewright import parallel
from notewright.operators import containment as C
from notewright.operators import entities as E
from notewright.session import stage

rng = random.Random(12)
TEXTS = [(i % 7, i, "".join(rng.choices("abc é😀", k=rng.choice([0, 1, 3, 9, 40, 300])))) for i in range(120)] + [(1, 200, None), (2, 201, "aaaa" * 900)]
WORDS = [(i % 7, "".join(rng.choices("abc é😀", [5, 5, 5, 1, 1, 1], k=rng.choice([0, 1, 2, 3, 4, 5, 6, 8])))) for i in range(150)] + [(2, "a" * 700), (2, "a" * 1500 + "b"), (3, None)]


def tables(spark):
    texts = spark.createDataFrame(TEXTS, "id long, n long, low string")
    return texts, spark.createDataFrame(WORDS, "id long, word string")


def test_global_needles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 50)
    texts, words = tables(spark)
    got = rows(C.occurrences(texts, words.select("word"), keep=["n"]))
    want = {(n, w) for _, n, t in TEXTS for _, w in WORDS if t and w and w in t}
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_needles_of_a_group_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 50)
    texts, words = tables(spark)
    for longer in (False, True):
        got = rows(C.occurrences(texts, words, on=["id"], keep=["id"], longer=longer))
        want = {(i, w) for i, _, t in TEXTS for j, w in WORDS if i == j and t and w and w in t and (not longer or len(t) > len(w))}
        assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_a_text_gives_a_row_for_each_place_at_most(spark):
    texts, _ = tables(spark)
    n = texts.filter("low <> ''").select(F.size(C.grams(F.col("low"), [4])).alias("n"), F.length("low").alias("size"))
    assert n.filter("n > size").count() == 0 and n.filter("n > 0").count() > 0


def test_anchor_is_the_rarest_gram(spark):
    texts = spark.createDataFrame([("left knee",), ("left hip",), ("left",), ("sore left knee",)], "low string").withColumn("n", F.lit(1))
    words = spark.createDataFrame([("left knee",), ("left toe",), ("le",)], "word string")
    got = dict(rows(C.anchors(words, texts, [2, 4])))
    assert set(got) == {"left knee", "le"} and got["le"] == "le" and got["left knee"] != "left"


def test_empty_tables(spark):
    texts, words = tables(spark)
    assert C.occurrences(texts.limit(0), words, on=["id"], keep=["id"]).count() == 0
    assert C.occurrences(texts, words.limit(0), on=["id"], keep=["id"]).count() == 0


def test_dedup_of_a_large_group_equals_the_greedy_pass(spark):
    spans = list(dict.fromkeys(" ".join(rng.choices(["left", "right", "knee", "kneecap", "pain", "a"], k=rng.randint(1, 4))) for _ in range(200)))
    df = spark.createDataFrame([(1, i, s, "symptom", 0.5) for i, s in enumerate(spans)], "id long, pos long, text string, label string, score double")
    kept = []
    for s in sorted(spans, key=len, reverse=True):
        if not any(s in k for k in kept):
            kept.append(s)
    assert sorted(r.text for r in E.dedup_entities(df).collect()) == sorted(kept)


def test_texts_in_many_rows_are_searched_once(spark):
    texts = spark.createDataFrame([(i, t) for i in range(50) for t in ("left knee", "knee", "Ne")], "id long, low string")
    held = rows(C.held_words(texts, texts.withColumnRenamed("low", "word"), longer=True))
    assert held == [("left knee", "knee")]


def test_dedup_keeps_spans_without_a_label_and_in_other_documents(spark):
    spans = [(1, 0, "left knee", "a", 0.5), (1, 1, "knee", "a", 0.5), (1, 2, "left", None, 0.5), (1, 3, "nee", "b", 0.5), (2, 0, "knee", "a", 0.5), (None, 0, "knee", "a", 0.5), (None, 1, "left knee", "a", 0.5), (3, 0, None, "a", 0.5)]
    got = rows(E.dedup_entities(spark.createDataFrame(spans, "id long, pos long, text string, label string, score double")), "id", "pos")
    assert got == sorted([(1, 0), (1, 2), (1, 3), (2, 0), (None, 0), (None, 1), (3, 0)], key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_texts_and_their_grams_are_never_sent_to_the_driver(spark, monkeypatch, sent_bytes):
    """Repeated texts make a small file and many rows in memory: the smaller file must not decide what is sent."""
    monkeypatch.setattr(parallel, "SENT_BYTES", sent_bytes)
    words = [f"{i * 7919 % 100_003:05d}{i}" for i in range(400)]
    texts = stage(spark.createDataFrame([(i, f"a note with {words[i % 3]} in it " * 20) for i in range(2000)], "id long, low string"))
    needles = stage(spark.createDataFrame([(w,) for w in words], "word string"))
    found = C.occurrences(texts, needles, keep=["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("SortMergeJoin" in plan) == (sent_bytes == 0)
    assert rows(found) == sorted(((i, words[i % 3]) for i in range(2000)), key=lambda t: tuple((v is None, str(v)) for v in t))


def test_a_table_is_sent_by_its_size_in_memory(spark, monkeypatch):
    held = stage(spark.createDataFrame([("a text that many rows repeat", i) for i in range(5000)], "low string, n long"))
    monkeypatch.setattr(parallel, "SENT_BYTES", 100_000)
    joined = stage(spark.range(9).selectExpr("'a text that many rows repeat' AS low", "id")).join(parallel.sent_if_small(held.filter("n < 5000")), "low")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and joined.count() == 45_000
    few = held.filter("n < 10")
    assert "Broadcast" in few.join(parallel.sent_if_small(few), "low")._jdf.queryExecution().executedPlan().toString()
