"""Observed readers, the ledger of done keys, and dialogues put together from a stream of turns."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from notewright.operators.dialogues import assemble_dialogues
from notewright.sources import files
from notewright.sources.ledger import Ledger, stream_once
from notewright.streaming import tagging


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# ------------------------------------------------------------------- readers


def test_bad_lines_of_pairs_are_counted_and_kept(spark, tmp_path):
    a = write(tmp_path / "a.csv", 'id,note,dialogue\n1,"two\nlines, ""quoted""",hi\n2,a,b,extra\nx,bad id,q\n3,,\n4,short\n')
    b = write(tmp_path / "b.csv", "dialogue,id,note,more\nhello,5,n,z\n")
    c = write(tmp_path / "c.csv", 'id,note,dialogue\n6,fine,d\n7,"never ends,d\n8,lost,d\n')
    counts = Observation()
    got = files.read_pairs(spark, [a, b, c], observation=counts)
    assert rows(got, "id", "note", "dialogue", "more") == [(1, 'two\nlines, "quoted"', "hi", None), (3, None, None, None), (5, "n", "hello", "z"), (6, "fine", "d", None)]
    assert counts.get == {"n_rows": 4, "n_bad_lines": 4}
    table = files.read_csv_observed(spark, [a, b, c], ["id"])
    bad = rows(table.bad_lines)
    assert [f.rsplit("/", 1)[1] for f, _ in bad] == ["a.csv"] * 3 + ["c.csv"] and any("8,lost" in line for _, line in bad)


def test_submissions_are_read_by_header_and_counted(spark, tmp_path):
    paths = [write(tmp_path / f"run_t0.{i}.csv", f"id,generated_note\n{i},x{i}\n") for i in range(5)]
    paths.append(write(tmp_path / "other + one.csv", "generated_note,extra,id\ny,1,8\nz,1,bad\nw,1,9,9\n"))
    counts = Observation()
    got = files.read_submissions(spark, paths, counts)
    assert rows(got) == sorted([("other + one", 8, "y"), *((f"run_t0.{i}", i, f"x{i}") for i in range(5))], key=lambda t: tuple((False, str(v)) for v in t))
    assert counts.get == {"n_rows": 6, "n_bad_lines": 2}
    # One scan for each of the two headers.
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_parquet_pairs_are_counted_too(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "n", "d")], "id long, note string, dialogue string").write.parquet(path)
    counts = Observation()
    assert files.read_pairs(spark, path, observation=counts).count() == 1 and counts.get == {"n_rows": 1, "n_bad_lines": 0}


# -------------------------------------------------------------------- ledger


def halves(df):
    """Odd keys give two rows, even ones none."""
    return df.filter("id % 2 = 1").select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"))


def test_keys_without_rows_are_not_taken_on_again(spark, tmp_path):
    ledger, seen = Ledger(spark, str(tmp_path / "l")), []

    def transform(df):
        seen.append(sorted(r.id for r in df.collect()))
        return halves(df)

    assert ledger.rows() is None and ledger.done() is None
    for n in (4, 10, 10):
        ledger.process(spark.range(n), transform)
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9], []]
    assert rows(ledger.rows(), "id", "x") == rows(halves(spark.range(10)))
    assert rows(ledger.commits(), "nth", "n_keys", "n_rows") == [(0, 4, 4), (1, 6, 6), (2, 0, 0)]


@pytest.mark.parametrize("at", ("rows", "commits"))
def test_a_batch_that_fails_adds_nothing(spark, tmp_path, monkeypatch, at):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.process(spark.range(3), halves)
    make = spark.createDataFrame

    def broken(df):
        return halves(df).withColumn("x", F.raise_error(F.lit("lost"))).withColumn("x", F.col("x").cast("string"))

    with pytest.raises(Exception, match="lost"):
        if at == "rows":
            ledger.process(spark.range(8), broken)
        else:  # keys and rows are written, the commit is not
            monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            ledger.process(spark.range(8), halves)
    monkeypatch.undo()
    assert make is not None and rows(ledger.rows(), "id", "x") == rows(halves(spark.range(3)))
    assert sorted(r.id for r in ledger.done().collect()) == [0, 1, 2]
    ledger.process(spark.range(8), halves)
    assert rows(ledger.rows(), "id", "x") == rows(halves(spark.range(8)))


def test_a_batch_that_is_tried_again_adds_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    assert ledger.process(spark.range(5), halves, "b0") and not ledger.process(spark.range(9), halves, "b0")
    assert rows(ledger.rows(), "id", "x") == rows(halves(spark.range(5)))


def test_stream_fails_in_between_and_goes_on(spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = spark.range(1).schema

    def run(transform):
        stream_once(tagging.read_arriving(spark, inbox, schema), out, ckpt, transform).awaitTermination(120)

    spark.range(0, 6).coalesce(1).write.mode("append").parquet(inbox)
    run(halves)
    spark.range(4, 12).coalesce(1).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="lost"):
        run(lambda df: halves(df).withColumn("x", F.raise_error(F.lit("lost")).cast("string")))
    assert rows(Ledger(spark, out).rows(), "id", "x") == rows(halves(spark.range(6)))
    run(halves)
    run(halves)
    assert rows(Ledger(spark, out).rows(), "id", "x") == rows(halves(spark.range(12)))
    assert sorted(r.id for r in Ledger(spark, out).done().collect()) == list(range(12))


# ------------------------------------------------------------------- streams


def at(minute):
    return dt.datetime(2026, 1, 1, 8) + dt.timedelta(minutes=minute)


def test_dialogues_from_turns_in_several_files(spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    one = [(1, 0, "user", "hello", at(0)), (2, 1, "user", None, at(12)), (1, 2, "user", "bye", at(8)), (None, 0, "user", "no id", at(1)), (5, 0, "user", "no time", None)]
    two = [(2, 0, "system", "rules", at(10)), (1, 1, "assistant", "yes?", at(4)), (3, 0, "user", "later", at(70)), (2, 2, "user", "again", at(14)), (2, 2, "user", "again", at(14))]
    closing = [(9, 0, "user", "end", at(400))]
    late = [(1, 3, "user", "too late", at(20)), (3, 1, "user", "after a silence", at(395))]
    last = [(9, 1, "user", "end", at(2000))]

    def step(turns):
        spark.createDataFrame(turns, tagging.TURN_FILES).coalesce(1).write.mode("append").parquet(inbox)
        query = tagging.stream_dialogues(spark, inbox, out, ckpt)
        query.awaitTermination(120)
        return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

    step(one)
    step(two)
    assert spark.read.schema("id long").parquet(out).count() == 0  # none is over yet
    step(closing)
    got = spark.read.parquet(out)
    batch = assemble_dialogues(spark.createDataFrame(one[:3] + two, tagging.TURN_FILES))
    assert rows(got, "id", "dialogue") == rows(batch)
    # A late turn is dropped and counted; one after a silence is a dialogue of its own.
    assert step(late) == 1
    step(last)
    got = spark.read.parquet(out)
    assert rows(got.filter("id = 3"), "dialogue") == [("[user]: after a silence",), ("[user]: later",)]
    assert got.filter("id = 1").count() == 1 and got.filter(F.contains("dialogue", F.lit("too late"))).count() == 0
    table = tagging.closed_dialogues(spark.createDataFrame(one + two, tagging.TURN_FILES))
    assert rows(table, "id", "dialogue") == rows(batch)
