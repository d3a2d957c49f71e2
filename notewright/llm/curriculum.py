"""Mixing sources to target weights by a curriculum whose weights change over the training run.

Every source has a schedule: its weight at some times between 0 and 1, linear in between. The integral of the schedule
is the source's weight in the mix. All sources share a budget of words by these weights; a target stops at ``repeats`` times the
source's own words, and what lies above is shared among the others until no target is above its limit.

The integral up to time t, as a share of the whole integral, is the share of its target that a source has handed out by t.
A source hands out its documents in an order fixed by the hash of their ids, and starts again when it is through. So a document
begins when the demand has grown to the words before it: its position is the inverse of the integral at that share, in closed form
within a piece of the schedule. All documents are then sorted by position. The last document of a source is cut where the target is reached.

Only DataFrame functions are used. A source may hold any share of the rows: rows are dealt by ranges of (source, hash), each range
learns what the ranges before it add up to, and no window spans more than a range of one source.

Null texts have no words; rows without words are returned but never taken. A null source is a source of its own, the last one. A row
with a null id sorts behind its source's other rows. Repeated rows count one by one. An empty table gives an empty result. Very long texts are
counted whole. Equal positions are ordered by source, then by the order within it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.common import task_count, text_of
from notewright.llm.sharding import _offsets, _with_task
from notewright.session import stage

ROWS_PER_TASK = 1_000_000
# (time, weight) from 0 to 1. The integrals are 5, 2 and 1: the first kind of source leads at the start, the third at the end.
SCHEDULES = (
    ((0.0, 7.0), (0.5, 5.0), (1.0, 3.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.0), (0.5, 0.5), (1.0, 3.0)),
)
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space, without a list of them: each run, with the space before it, becomes one letter."""
    marks = F.regexp_replace(text, f"[{_SPACE}]*[^{_SPACE}]+", "x")
    return F.octet_length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def _pieces(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(integral before, begin, width, weight at the begin, slope) of each linear piece, and checks."""
    times = [t for t, _ in schedule]
    if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in schedule) < 0:
        raise ValueError("a schedule needs growing times from 0 to 1 and no negative weight")
    out, before = [], 0.0
    for (t, w), (t2, w2) in zip(schedule, schedule[1:]):
        out.append((before, t, t2 - t, w, (w2 - w) / (t2 - t)))
        before += (t2 - t) * (w + w2) / 2
    return out


def integral(schedule: Sequence[tuple[float, float]]) -> float:
    return sum((t2 - t) * (w + w2) / 2 for (t, w), (t2, w2) in zip(schedule, schedule[1:]))


def _inverse(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral reaches ``share`` of the whole."""
    whole, time = integral(schedule), None
    for before, begin, width, weight, slope in _pieces(schedule):
        rest = share * F.lit(whole) - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * rest, F.lit(0.0)))
        step = F.when(rest > 0, F.lit(2.0) * rest / (F.lit(weight) + root)).otherwise(F.lit(0.0))
        here = F.lit(begin) + F.least(step, F.lit(width))
        time = here if time is None else F.when(rest > 0, here).otherwise(time)
    return time


def targets(sources: DataFrame, budget: float, repeats: int) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``: the budget shared by weight, none above ``repeats`` times its size.

    Each round one aggregation gives what the sources below their limit have to share; it ends when none more reaches its limit.
    """
    limit, level, done = F.col("source_size") * repeats, 0.0, None
    while True:
        full = F.col("weight") * level >= limit
        used, open_weight, n_full = sources.agg(
            F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if n_full == done or not open_weight:
            break
        done, level = n_full, (budget - used) / open_weight
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * level))


def curriculum(
    docs: DataFrame,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    budget: float = 1.5,
    repeats: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (row, doc_id, source, size, source_size, target, pass, words, at, slot) in training order.

    The sources in code-point order take the ``schedules`` in turn; ``budget`` is the share of all words that the mix has.
    One row for each time that a document is taken, with the ``words`` taken then, its position ``at`` from 0 to 1 and its ``slot``, gapless from 0. A document
    that is never taken has one row without words, ``at`` and ``slot``, behind all others. ``row`` numbers the rows of ``docs``.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            # Sorts like the source, null last, and joins like any other.
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("key"),
            word_count(text_of(text_col)).alias("size"),
            F.unhex(F.md5(F.col(id_col).cast("string"))).alias("order"),
        ),
        "mix-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = task_count(spark, n, ROWS_PER_TASK)
    sources = stage(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sources")
    ranked = _with_task(sources, task_count(spark, sources.count(), ROWS_PER_TASK), "key", name="mix-ranks")
    turn = (F.row_number().over(Window.partitionBy("task").orderBy("key")) - 1 + F.col("before")) % len(schedules)
    weight = F.element_at(F.array(*(F.lit(integral(s)) for s in schedules)), F.col("turn") + 1)
    ranked = ranked.join(_offsets(ranked, F.count("*")), "task").withColumn("turn", turn.cast("int")).withColumn("weight", weight)
    sources = stage(targets(stage(ranked.select("key", "source_size", "turn", "weight"), "mix-weights"), budget * total, repeats), "mix-targets")

    by = ["key", F.asc_nulls_last("order"), F.asc_nulls_last("doc_id"), "size"]
    placed = _with_task(rows, tasks, *by, name="mix-placed")
    own = Window.partitionBy("task", "key").orderBy(*by[1:])
    so_far = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    facts = _offsets(placed, F.sum("size"), "key").join(sources, "key")
    ahead = (
        placed.select("*", so_far.alias("ahead"), F.row_number().over(own).alias("nth"))
        .join(facts, ["task", "key"])
        .withColumn("ahead", F.col("ahead") + F.col("before"))
        .withColumn("row", F.concat_ws(":", "task", "key", "nth"))
        .withColumn("demand", F.floor("target").cast("long"))
    )
    passes = ahead.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("begin", (F.col("pass") - 1) * F.col("source_size") + F.col("ahead"))
    words = F.greatest(F.least(F.col("demand") - F.col("begin"), F.col("size")), F.lit(0))
    share, at = F.col("begin") / F.col("demand"), F.lit(None)
    for k, s in enumerate(schedules):
        at = F.when(F.col("turn") == k, _inverse(share, s)).otherwise(at)
    taken = (
        passes.withColumn("words", words)
        .filter("pass = 1 OR words > 0")
        .withColumn("at", F.when(F.col("words") > 0, F.round(at, 9)))
    )
    when = [F.asc_nulls_last("at"), *by, "pass"]
    sorted_ = _with_task(
        taken.select("row", "doc_id", "source", "key", "order", "size", "source_size", "target", "pass", "words", "at"), task_count(spark, 2 * n, ROWS_PER_TASK), *when, name="mix-order"
    )
    slot = F.row_number().over(Window.partitionBy("task").orderBy(*when)) - 1 + F.col("before")
    return (
        sorted_.join(_offsets(sorted_, F.count("*")), "task")
        .withColumn("slot", F.when(F.col("words") > 0, slot.cast("long")))
        .select("row", "doc_id", "source", "size", "source_size", "target", F.col("pass").cast("int").alias("pass"), "words", "at", "slot")
    )
