"""Shards of near equal size: the minimax contiguous partition of ordered groups.

Rows with equal texts are one atomic group. Groups are ordered by their smallest doc_id,
then by the hash of the text. Among all ways to cut that order into ``n_shards`` runs, the
one taken has the smallest possible largest shard: the smallest feasible capacity is found by
binary search, each candidate is checked by greedy filling, and the cuts are the greedy
ones at that capacity.

The check never needs all groups. With E the running totals, the greedy search is first run
on one total out of each of ``fences`` equal ranges. Moving a cut to the next such
total changes a shard by less than the width of a range, so the true capacity lies within one
width below the one found, and each true cut lies in a stretch known by greedy bounds. Only these
stretches are looked at more closely in the next round, until every total in them
is known. The driver holds at most ``fences`` totals. Where very large groups keep the stretches from shrinking, what is left
of the binary search is run on the whole table: one aggregation per shard looks up the cuts of many capacities at once.

Null texts are empty texts. A row with a null doc_id sorts before all others. Repeated rows
count one by one. An empty table gives an empty result. Shards may stay empty where there are
fewer groups than shards. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.common import join_facts, task_count, text_of
from notewright.session import stage

FENCES = 1 << 14
ROWS_PER_TASK = 1_000_000


def greedy_cuts(ends: list[int], capacity: int, shards: int, start: int = 0) -> list[int]:
    """The last running total that fits into each shard, filling one after another."""
    cuts = []
    for _ in range(shards):
        at = bisect_right(ends, start + capacity)
        start = max(start, ends[at - 1]) if at else start
        cuts.append(start)
    return cuts


def smallest_capacity(ends: list[int], shards: int, lo: int, hi: int) -> int:
    """The smallest capacity in [lo, hi] whose greedy filling reaches the end; ``hi`` does."""
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(ends, mid, shards)[-1] >= ends[-1]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def minimax_cuts(ends: DataFrame, shards: int, fences: int = FENCES) -> list[int]:
    """Table with a column ``end`` of running totals -> the totals at which the shards end."""
    if fences < 8 * shards * shards:
        raise ValueError("too few fences for the stretches to shrink")
    total = ends.agg(F.max("end")).first()[0]
    if total is None:
        return [0] * shards
    low, high = -(-total // shards), total
    stretches = [(0, total)]  # half open on the left; all totals that may matter lie in them
    before = 2 * total + 2
    while True:
        width = max(1, -(-sum(b - a for a, b in stretches) // fences))
        if 2 * width > before:
            return _searched(ends, shards, low, high, total)
        before = width
        inside, base, bucket = F.lit(False), 0, F.lit(None).cast("long")
        for a, b in stretches:
            here = (F.col("end") > a) & (F.col("end") <= b)
            inside, bucket = inside | here, F.when(here, base + F.floor((F.col("end") - 1 - a) / width)).otherwise(bucket)
            base += (b - a) // width + 1
        found = ends.filter(inside).groupBy(bucket.alias("bucket")).agg(F.max("end").alias("end"), F.min("end").alias("first")).collect()
        known = sorted({r["end"] for r in found} | {total})
        exact = all(r["first"] == r["end"] for r in found)
        capacity = smallest_capacity(known, shards, low, high)
        if exact:
            return greedy_cuts(known, capacity, shards)
        low, high = max(low, capacity - width), capacity
        # Greedy cuts at the lowest and the highest capacity that are left enclose the true ones; a
        # true cut may lie up to a width beyond a known total for every shard before it.
        first, last = greedy_cuts(known, low, shards), greedy_cuts(known, high, shards)
        stretches = _merged([(max(0, a - 1), min(total, b + (k + 2) * width)) for k, (a, b) in enumerate(zip(first, last))])


def _searched(ends: DataFrame, shards: int, low: int, high: int, total: int, ways: int = 32) -> list[int]:
    """Cuts at the smallest feasible capacity in [low, high], every check made on all totals."""

    def cuts_of(capacities: list[int]) -> list[list[int]]:
        cuts = [[0] for _ in capacities]
        for _ in range(shards):
            fits = (F.max(F.when(F.col("end") <= c[-1] + size, F.col("end"))) for c, size in zip(cuts, capacities))
            for c, found in zip(cuts, ends.agg(*(f.alias(f"c{i}") for i, f in enumerate(fits))).first()):
                c.append(max(c[-1], found or 0))
        return [c[1:] for c in cuts]

    while low < high:
        tried = sorted({low + (high - low) * i // ways for i in range(ways)})
        fits = [c for c, cuts in zip(tried, cuts_of(tried)) if cuts[-1] >= total]
        high = min(fits, default=high)
        low = max([low, *(c + 1 for c in tried if c < high)])
    return cuts_of([high])[0]


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _with_task(df: DataFrame, tasks: int, *order: Column | str, name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, each row with the number of its range."""
    return stage(df.repartitionByRange(tasks, *order).withColumn("task", F.spark_partition_id()), name)


def _offsets(df: DataFrame, total: Column, *keys: str) -> DataFrame:
    """Per range (and key) what all ranges before it add up to; one row per range and key."""
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("task", *keys).agg(total.alias("own"))
    return sums.select("task", *keys, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot); ``slot`` counts from 0 in every shard.

    ``size`` is the text's UTF-8 bytes plus one. Slots follow the order of groups, then doc_id.
    """
    spark, text = docs.sparkSession, text_of(text_col)
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(
        F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n_rows")
    )
    n = rows.count()
    groups = _with_task(groups, task_count(spark, n, ROWS_PER_TASK), F.asc_nulls_first("first"), "group", name="shard-groups")
    within = Window.partitionBy("task").orderBy(F.asc_nulls_first("first"), "group")
    ends = stage(
        groups.withColumn("own", F.sum("bytes").over(within))
        .join(_offsets(groups, F.sum("bytes")), "task")
        .select("group", "first", "n_rows", (F.col("own") + F.col("before")).alias("end")),
        "shard-ends",
    )
    cuts = minimax_cuts(ends.select("end"), n_shards)
    # A group lies in the first shard that ends at or after the group's own end.
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    facts = stage(ends.select("group", "first", "n_rows", shard.alias("shard")), "shard-facts")
    placed = _with_task(
        join_facts(rows, facts, "group", "n_rows"),
        task_count(spark, n, ROWS_PER_TASK),
        F.asc_nulls_first("first"), "group", F.asc_nulls_first("doc_id"),
        name="shard-placed",
    )
    order = Window.partitionBy("task", "shard").orderBy(F.asc_nulls_first("first"), "group", F.asc_nulls_first("doc_id"))
    return (
        placed.withColumn("own", F.row_number().over(order) - 1)
        .join(_offsets(placed, F.count("*"), "shard"), ["task", "shard"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
    )
