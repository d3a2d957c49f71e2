"""What several of the operators need: joins that survive hot keys, bounded filters, exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is heavy when it has over a thousandth of all rows, so there are fewer than this many.
HEAVY = 1000
# Entries of a bucket filter: the most rows of such a broadcast, whatever the input.
FILTER_BUCKETS = 1 << 18


def text_of(col: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with one fact row per key, safe against hot keys.

    ``weight`` is the number of rows with that key in ``rows``. Keys with over a
    thousandth of all rows are fewer than ``HEAVY``, whatever the data, so they are
    broadcast and their rows stay where they are. All other keys are too small to
    make a hot task of a shuffled join. Both tables are read twice: stage them.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY > total
    heavy = F.broadcast(facts.filter(is_heavy))
    hot = rows.join(heavy, key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts.filter(~is_heavy), key)
    return hot.unionByName(cold)


def bucket_of(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BUCKETS))


def without_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``dropped``; rows with a null key stay.

    A broadcast of at most ``FILTER_BUCKETS`` hash buckets lets most rows pass in
    place, text and all; only rows in a bucket with a dropped key are shuffled for
    the exact anti join. ``dropped`` is read twice: stage it.
    """
    marked = _marked(docs, dropped, key)
    clear = marked.filter(F.col("__n").isNull())
    # The condition names the count, else the optimizer would move the anti join below the filter, to all rows.
    gone = dropped.select(F.col(key).alias("__gone")).distinct()
    suspect = marked.filter(F.col("__n").isNotNull()).join(gone, (F.col("__n") > 0) & (F.col(key) == F.col("__gone")), "left_anti")
    return clear.unionByName(suspect).select(*docs.columns)


def _marked(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``__n``, the rows of ``ids`` in the same bucket, or null."""
    buckets = ids.groupBy(bucket_of(key).alias("__bucket")).agg(F.count("*").alias("__n"))
    return docs.withColumn("__bucket", bucket_of(key)).join(F.broadcast(buckets), "__bucket", "left")


def with_bucket(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` in a bucket with a wanted key: all that have one, and some that don't."""
    return _marked(docs, wanted, key).filter(F.col("__n").isNotNull()).select(*docs.columns)


def with_ids(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``wanted``; only rows in a bucket with a wanted key are shuffled."""
    found = wanted.select(F.col(key).alias("__found")).distinct()
    near = _marked(docs, wanted, key).filter(F.col("__n").isNotNull())
    return near.join(found, F.col(key) == F.col("__found")).select(*docs.columns)  # a semi join would be moved below the filter


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 1 << 14) -> int | None:
    """The k-th largest value of a LONG column, exactly; None when there are fewer rows.

    Each round counts the rows of ``bins`` equal ranges and goes on inside the range
    that holds the k-th, so only ``bins`` counts ever reach the driver.
    """
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        width = (hi - lo) // bins + 1
        counts = dict(
            df.filter(F.col(col).between(lo, hi))
            .groupBy(F.expr(f"({col} - {lo}L) div {width}L").alias("bin"))
            .count()
            .collect()
        )
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= counts[b]
    return lo


def task_count(spark, rows: int, per_task: int) -> int:
    """Partitions for ``rows``: the session's number, or more where the rows need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)
