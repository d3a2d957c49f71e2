import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from notewright.operators.entities import tag_words
from notewright.sources import files
from notewright.streaming import tagging


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_pairs_keeps_line_breaks_and_sets_bad_lines_apart(spark, tmp_path):
    path = write(
        tmp_path / "p.csv",
        'id,note,dialogue\n1,"line one\nline ""two""",hi\n2,a,b,c,d\nx,bad id,q\n3,,empty\n',
    )
    good, bad = files.read_csv_table(spark, path, ["id", "note"])
    assert rows(good, "id", "note") == [(1, 'line one\nline "two"'), (3, None)]
    assert bad.count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        files.read_pairs(spark, write(tmp_path / "q.csv", "id,text\n1,a\n"))


def test_submissions_take_their_name_from_the_file(spark, tmp_path):
    a = write(tmp_path / "run_t0.1.csv", "id,generated_note\n1,x\n")
    b = write(tmp_path / "other.csv", "generated_note,id\ny,1\n")
    assert rows(files.read_submissions(spark, [a, b])) == [("other", 1, "y"), ("run_t0.1", 1, "x")]
    with pytest.raises(ValueError):
        files.read_submissions(spark, [write(tmp_path / "c.csv", "id,note\n1,x\n")])


def test_retrieval_cache_last_line_wins(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,retrieved_note\n1,a\n2,b\n1,c\n")
    assert rows(files.read_retrieval_cache(spark, path)) == [(1, "c"), (2, "b")]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nthen go', "d")], "id long, note string, dialogue string")
    for fmt in ("csv", "parquet"):
        out = str(tmp_path / f"t.{fmt}")
        files.write_table(df, out, fmt)
        assert rows(files.read_pairs(spark, out), "id", "note", "dialogue") == rows(df)
    files.write_report(spark.createDataFrame([(0.5,)], "bleu double"), str(tmp_path / "r"), "run1", "json")
    part = next((tmp_path / "r").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"submission": "run1", "bleu": 0.5}
    files.write_table(df.withColumn("config", F.lit("x")), str(tmp_path / "by"), partition_by=["config"])
    assert (tmp_path / "by" / "config=x").is_dir()


def test_resume_adds_each_key_once(spark, tmp_path):
    out = str(tmp_path / "done")
    source = spark.range(10)

    def mark(df):
        return df.withColumn("x", F.col("id") * 2)

    files.resume_incremental(source.filter("id < 4"), out, mark)
    files.resume_incremental(source, out, mark)
    files.resume_incremental(source, out, mark)
    assert rows(spark.read.parquet(out)) == rows(mark(source))


def test_stream_tags_each_file_once_and_equals_batch(spark, tmp_path):
    lex = spark.createDataFrame([("back pain", "symptom", 0.9), ("fever", "symptom", 0.8)], "phrase string, label string, score double")
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first = spark.createDataFrame([(1, "Back pain, FEVER"), (2, "none")], tagging.DIALOGUE_FILES)
    second = spark.createDataFrame([(3, "fever fever")], tagging.DIALOGUE_FILES)
    for part in (first, second, None):
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(inbox)
        tagging.stream_tag(spark, inbox, out, ckpt, lex, max_words=2).awaitTermination(120)
    got = spark.read.parquet(out)
    assert rows(got) == rows(tag_words(first.unionByName(second), lex, "dialogue", 2))
    assert got.count() == 4


def test_stream_parse(spark, tmp_path):
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.createDataFrame(
        [(1, '[{"text": "the cough", "label": "symptom", "score": 0.5}]'), (2, "oops")], tagging.RESPONSE_FILES
    ).write.parquet(inbox)
    tagging.stream_parse(spark, inbox, out, ckpt).awaitTermination(120)
    assert rows(spark.read.parquet(out)) == [(1, 0, "cough", "symptom", 0.5)]
