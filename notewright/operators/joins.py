"""Pairing, coverage, reconciliation and lookups between keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import is_blank, text_or_empty


def pair_up(
    submission: DataFrame, gold: DataFrame, extra: Sequence[str] = (), keys: Sequence[str] = ("id",)
) -> DataFrame:
    """``(keys…, pred, ref, extra…)``: inner join on ``id``, null text as empty text."""
    left = submission.select(*keys, text_or_empty(F.col("generated_note")).alias("pred"))
    right = gold.select(
        "id",
        text_or_empty(F.col("note")).alias("ref"),
        *[text_or_empty(F.col(c)).alias(c) for c in extra],
    )
    return left.join(right, "id", "inner")


def coverage(submission: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold rows, matched pairs, missing ids, matched in percent of gold."""
    per_id = submission.groupBy("id").agg(F.count("*").alias("n"))
    return (
        gold.select("id")
        .join(per_id, "id", "left")
        .agg(
            F.count("*").alias("n_gold"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_matched"),
            F.count_if(F.col("n").isNull()).alias("n_missing"),
        )
        .withColumn(
            "coverage",
            F.round(
                F.when(F.col("n_gold") > 0, 100.0 * F.col("n_matched") / F.col("n_gold")).otherwise(
                    0.0
                ),
                4,
            ),
        )
    )


def missing_ids(submission: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.select("id").join(submission.select("id"), "id", "left_anti")


def require_match(submission: DataFrame, gold: DataFrame) -> DataFrame:
    """The coverage row, or ValueError when not one id matches."""
    report = coverage(submission, gold)
    if report.first()["n_matched"] == 0:
        raise ValueError("submission and gold table have no id in common")
    return report


def merge_reconciled(annotated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Annotated rows with their retrieved note; rows without a partner are dropped."""
    return annotated.select("id", "dialogue", "note", "entities_json").join(
        retrieved.select("id", "retrieved_note"), "id", "inner"
    )


def merge_report(annotated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row with the row counts on both sides and after the merge."""
    sides = (
        annotated.select("id", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(retrieved.select("id", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("id")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    total = sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_annotated"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_retrieved"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_merged"),
    )
    lost = (F.col("n_merged") != F.col("n_annotated")) | (F.col("n_merged") != F.col("n_retrieved"))
    return total.withColumn("rows_lost", lost)


def last_per_key(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``; aggregates before the shuffle."""
    return table.groupBy(key).agg(F.max_by(value, order).alias(value))


def lookup_left(
    df: DataFrame,
    table: DataFrame,
    key: str,
    value: str,
    order: str | None = None,
    default: object = "",
) -> DataFrame:
    """``df`` with ``value`` looked up by ``key``; duplicate keys: last one wins."""
    unique = last_per_key(table, key, value, order) if order else table.select(key, value)
    return df.join(unique, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def resolve_inputs(
    df: DataFrame, retrieved: DataFrame, entities: DataFrame
) -> DataFrame:
    """Fill ``retrieved_note`` and ``entities_json``: own value, else cache, else default.

    Both caches have one row per id.
    """

    def own_or(own: Column, cached: Column, default: str) -> Column:
        return F.coalesce(F.when(~is_blank(own), own), cached, F.lit(default))

    cached = retrieved.select("id", F.col("retrieved_note").alias("cached_note"))
    tagged = entities.select("id", F.col("entities_json").alias("cached_entities"))
    return (
        df.join(cached, "id", "left")
        .join(tagged, "id", "left")
        .withColumn("retrieved_note", own_or(F.col("retrieved_note"), F.col("cached_note"), ""))
        .withColumn("entities_json", own_or(F.col("entities_json"), F.col("cached_entities"), "{}"))
        .drop("cached_note", "cached_entities")
    )


def resume_antijoin(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``source`` whose key is not in ``done`` yet."""
    return source.join(done.select(key), key, "left_anti")
