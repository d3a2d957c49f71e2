"""Dialogue tables: turns, chunks, splits, row selection, text gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import is_blank, strip, text_or_empty, word_count
from notewright.schema import CHUNK_WORDS


def assemble_dialogues(
    turns: DataFrame, id_col: str = "conv_id", role: str = "role", text: str = "text"
) -> DataFrame:
    """One ``[role]: text`` line per turn, joined into one dialogue per conversation.

    A group here is one output cell, so it is never larger than a single result value.
    """
    return turns.groupBy(F.col(id_col).alias("id")).agg(dialogue_text(role, text).alias("dialogue"))


def dialogue_text(role: str = "role", text: str = "text") -> Column:
    """The aggregate: lines in the order of ``turn``."""
    line = F.concat(F.lit("["), F.col(role), F.lit("]: "), text_or_empty(F.col(text)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda t: t["line"]), "\n")


def split_turns(
    df: DataFrame, col: str = "dialogue", roles: Sequence[str] = ("doctor", "patient")
) -> DataFrame:
    """Rows ``(id, turn, text)``: cut before each role marker, else at line ends."""
    parts = turn_array(F.col(col), roles)
    return df.select("id", F.posexplode(parts).alias("turn", "text")).withColumn(
        "turn", F.col("turn").cast("long")
    )


def turn_array(dialogue: Column, roles: Sequence[str]) -> Column:
    marker = r"(?i)(?=\[(?:" + "|".join(roles) + r")\]:)"
    dialogue = text_or_empty(dialogue)

    def tidy(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda t: t != "")

    by_role = tidy(F.split(dialogue, marker))
    return F.when(F.size(by_role) > 1, by_role).otherwise(tidy(F.split(dialogue, "\n")))


def chunk_turns(
    df: DataFrame,
    col: str = "dialogue",
    roles: Sequence[str] = ("doctor", "patient"),
    max_words: int = CHUNK_WORDS,
    min_chars: int = 5,
) -> DataFrame:
    """Pack turns in order into chunks of at most ``max_words`` words.

    A turn that is longer by itself stays whole. Row-local: no shuffle.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).cast("long").alias("n"),
    )

    def step(acc: Column, turn: Column) -> Column:
        n = word_count(turn)
        is_full = acc["open"].isNotNull() & (acc["n"] + n > max_words)
        return F.struct(
            F.when(is_full, F.array_append(acc["done"], acc["open"]))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(is_full, turn).otherwise(F.concat_ws(" ", acc["open"], turn)).alias("open"),
            F.when(is_full, n).otherwise(acc["n"] + n).alias("n"),
        )

    chunks = F.aggregate(
        turn_array(F.col(col), roles),
        start,
        step,
        lambda acc: F.array_compact(F.array_append(acc["done"], acc["open"])),
    )
    kept = F.filter(chunks, lambda c: F.length(strip(c)) >= min_chars)
    return df.select("id", F.posexplode(kept).alias("chunk", "text")).withColumn(
        "chunk", F.col("chunk").cast("long")
    )


def chunk_fixed(turns: DataFrame, per_chunk: int = 3) -> DataFrame:
    """Join every ``per_chunk`` turns of a dialogue; groups are that small by construction."""
    numbered = turns.withColumn("chunk", F.floor(F.col("turn") / per_chunk))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        numbered.groupBy("id", "chunk")
        .agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"))
        .filter(~is_blank(F.col("text")))
    )


def train_eval_split(
    df: DataFrame, key: str = "id", train_percent: int = 85, bucket: Column | None = None
) -> DataFrame:
    """Add ``split``; a row's side depends on its key alone, never on its neighbours."""
    spot = F.pmod(F.xxhash64(key), F.lit(100)) if bucket is None else bucket
    return df.withColumn("split", F.when(spot < train_percent, "train").otherwise("eval"))


def first_n(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def lookup_examples(
    df: DataFrame, ids: Sequence[int], entities: DataFrame | None = None
) -> DataFrame:
    """The example rows with the given ids, with ``entities_json`` where there is any."""
    rows = df.filter(F.col("id").isin(*ids))
    if entities is None:
        return rows
    found = entities.filter(F.col("id").isin(*ids)).select("id", "entities_json")
    return rows.join(found, "id", "left").withColumn(
        "entities_json", F.coalesce("entities_json", F.lit("[]"))
    )


# ---------------------------------------------------------------------- gates


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        df = df.filter(~is_blank(F.col(c)))
    return df


def blank_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows in, and rows that :func:`drop_blank` would drop."""
    any_blank = F.lit(False)
    for c in cols:
        any_blank = any_blank | is_blank(F.col(c))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(any_blank).alias("n_skipped"),
    )


def gate_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per required column: how many rows lack it."""
    counted = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(is_blank(F.col(c))).alias(f"bad_{i}") for i, c in enumerate(cols)],
    )
    per_col = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"bad_{i}").alias("n_missing"))
            for i, c in enumerate(cols)
        ]
    )
    return counted.select("n_rows", F.inline(per_col))


def require_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` unchanged, or ValueError when a required column is blank somewhere."""
    bad = {r["column_name"]: r["n_missing"] for r in gate_counts(df, cols).collect()}
    bad = {c: n for c, n in bad.items() if n}
    if bad:
        raise ValueError(f"rows without required values: {bad}")
    return df
