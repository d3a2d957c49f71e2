"""Where work is far heavier than its input is large, bytes are a poor guide to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many rows a table may arrive in too few splits to keep all cores busy.
SMALL_ROWS = 1_000_000
# Bytes of the multiplied rows that one task should hold, and how many times the words and
# n-grams of a text, with their keys, are larger than the text in its file.
TASK_BYTES = 128 << 20
GROWTH = 16
# Catalyst gives an input of unknown size about the largest LONG. No scheduler likes more tasks than MOST.
UNKNOWN = 1 << 60
MOST = 100_000
# Bytes in memory of the rows that a join may send to all tasks, by way of the driver, and bytes of a row beside its strings.
SENT_BYTES = 8 << 20
ROW_BYTES = 64


def estimated_bytes(df: DataFrame) -> int | None:
    """The size of the inputs of ``df`` by Catalyst's estimate; None where it is not known.

    A plan's own estimate multiplies the sides of a join, so its inputs are added up.
    """
    if not hasattr(df, "_jdf"):
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(size >= UNKNOWN for size in sizes) else sum(sizes)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Cut by ``keys`` into partitions that grow with the input: :func:`partitions_for`.

    For rows that are about to be multiplied (words, n-grams): more and smaller
    partitions keep the multiplied rows in memory, and naming a number keeps adaptive
    execution from merging them by their size before that.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions_for(estimated_bytes(df), n), *keys)


def partitions_for(size: int | None, shuffle_partitions: int) -> int:
    """Twice the session's number, or as many as keep the multiplied rows of ``size`` bytes in ``TASK_BYTES`` each."""
    return max(2 * shuffle_partitions, min(MOST, -(-(size or 0) * GROWTH // TASK_BYTES)))


def spread_small(df: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """A small table spread over all cores; a large one as it is, it has splits enough.

    Without ``n_rows`` the rows are counted, which Parquet answers from its footers.
    """
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows > SMALL_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, n_rows)), key)


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, which should be stored, as the second side of a join: sent to all tasks if its rows are small in memory, else both sides are cut by the key.

    Catalyst goes by the size of files, and dictionaries make files far smaller than their rows.
    """
    strings = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    size = df.agg(F.sum(sum(strings, F.lit(ROW_BYTES)))).first()[0]
    return F.broadcast(df) if (size or 0) <= SENT_BYTES else df.hint("merge")
