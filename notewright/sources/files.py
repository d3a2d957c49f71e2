"""Reading and writing pair tables, submissions, annotated tables and reports."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright import schema as S
from notewright.operators.joins import resume_antijoin

BAD_LINE = "_bad_line"
FILE = "_file"

_KNOWN_TYPES = {"id": T.LongType()}


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
    )


@dataclass
class CsvTable:
    """``rows`` that fit, ``bad_lines`` (file, line) that don't, and after any action on ``rows`` the counts ``n_rows`` and ``n_bad_lines`` in ``counts.get``."""

    rows: DataFrame
    bad_lines: DataFrame
    counts: Observation


def _file() -> Column:
    """The file of a row; its path comes as a URI."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names -> the files that have them in this order. One job looks at the first lines of all files."""
    lines = (
        spark.read.text(list(paths))
        .select("value", _file().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
        .filter("start = 0")
        .groupBy("file")
        .agg(F.min_by("value", "nth").alias("header"))
    )
    found: dict[tuple[str, ...], list[str]] = {}
    for r in lines.sort("file").collect():  # a line for each file
        found.setdefault(tuple(next(csv.reader([r["header"].removeprefix("\ufeff")]), [])), []).append(r["file"])
    return found


def read_csv_observed(
    spark: SparkSession, path: str | Sequence[str], required: Sequence[str], observation: Observation | None = None
) -> CsvTable:
    """Quoted multi-line CSV files, one scan for each header that they have.

    A line with more or fewer values than its header, an id that is no number, or a quote that never ends is a bad line: it is kept in ``bad_lines`` and
    counted, and the others are read. Columns that only some files have are null in the rest. A file without a
    required column is an error, and so is one without any line. Extra columns are kept. ``file`` is where a row comes from. A quoted line break may sit anywhere, so one
    file is one task: keep large inputs in many files, or in Parquet.
    """
    paths = [path] if isinstance(path, str) else list(path)
    groups = _headers(spark, paths)
    for header, files in groups.items():
        if missing := [c for c in required if c not in header]:
            raise ValueError(f"missing columns {missing} in {files}; found {list(header)}")
    if not groups:
        raise ValueError(f"no lines in {paths}")
    scans = []
    for header, files in groups.items():
        fields = [T.StructField(c, _KNOWN_TYPES.get(c, T.StringType())) for c in header]
        scan = (
            _reader(spark)
            .schema(T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())]))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_LINE)
            .csv(files)
        )
        # Spark refuses to read the bad-line column alone, so the test looks at another one too.
        both = F.concat(F.col(BAD_LINE), F.coalesce(F.col(header[0]).cast("string"), F.lit("")))
        is_bad = F.coalesce(F.length(both) > 0, F.lit(False)).alias("_is_bad")
        scans.append(scan.select(*header, BAD_LINE, is_bad, _file().alias(FILE)))
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), scans)
    is_bad = F.col("_is_bad")
    counts = observation or Observation()
    observed = whole.observe(counts, F.count_if(~is_bad).alias("n_rows"), F.count_if(is_bad).alias("n_bad_lines"))
    bad = whole.filter(is_bad).select(F.col(FILE).alias("file"), F.col(BAD_LINE).alias("line"))
    return CsvTable(observed.filter(~is_bad).drop(BAD_LINE, "_is_bad"), bad, counts)


def read_csv_table(
    spark: SparkSession, path: str | Sequence[str], required: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``(rows, bad_lines)`` of :func:`read_csv_observed`, without the file of a row."""
    table = read_csv_observed(spark, path, required)
    return table.rows.drop(FILE), table.bad_lines


def read_pairs(
    spark: SparkSession, path: str | Sequence[str], required: Sequence[str] = ("id", "note", "dialogue"), observation: Observation | None = None
) -> DataFrame:
    """The pair table of ``path``: Parquet by extension, else CSV.

    ``observation`` gets ``n_rows`` and ``n_bad_lines`` with the first action on the result.
    """
    return _read(spark, path, required, observation)


def _read(spark: SparkSession, path, required: Sequence[str], observation: Observation | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        df = spark.read.parquet(*paths)
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing} in {paths}; found {df.columns}")
        return df if observation is None else df.observe(observation, F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_bad_lines"))
    return read_csv_observed(spark, paths, required, observation).rows.drop(FILE)


def read_annotated(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _read(spark, path, [f.name for f in S.ANNOTATED_SCHEMA])


def read_retrieval_cache(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``id, retrieved_note`` with one row per id: the last line wins."""
    df = _read(spark, path, ["id", "retrieved_note"])
    numbered = df.select("id", "retrieved_note", F.monotonically_increasing_id().alias("line"))
    return numbered.groupBy("id").agg(F.max_by("retrieved_note", "line").alias("retrieved_note"))


def read_submissions(spark: SparkSession, paths: Sequence[str], observation: Observation | None = None) -> DataFrame:
    """``config, id, generated_note`` of all files; config is the file's stem. Bad lines as in :func:`read_csv_observed`."""
    table = read_csv_observed(spark, paths, [f.name for f in S.SUBMISSION_SCHEMA], observation)
    return table.rows.select(F.regexp_replace(F.element_at(F.split(FILE, "/"), -1), r"\.[^.]*$", "").alias("config"), "id", "generated_note")


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Parquet, JSON or CSV (quoted so that line breaks survive), optionally by partition."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.format(fmt).save(path)


def write_report(report: DataFrame, path: str, submission: str, fmt: str = "csv") -> None:
    """A report of a few rows as one file, with the run's name as first column."""
    named = report.select(F.lit(submission).alias("submission"), "*")
    write_table(named.coalesce(1), path, fmt)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def resume_incremental(
    source: DataFrame, out_path: str, transform: Callable[[DataFrame], DataFrame], key: str = "id"
) -> None:
    """Transform and append only the rows whose key is not in ``out_path`` yet.

    ``transform`` keeps at least one row per key. Running it again adds nothing.
    """
    spark = source.sparkSession
    todo = source
    if table_exists(spark, out_path):
        done = spark.read.parquet(out_path).select(key).distinct()
        todo = resume_antijoin(source, done, key)
    transform(todo).write.mode("append").parquet(out_path)
