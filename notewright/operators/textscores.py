"""BLEU, ROUGE and METEOR over a pair table ``keys…, pred, ref``.

N-gram scores are relational: cut both texts into n-grams, count per pair, compare the
two counts, add up. The pair table is cut by ``id`` before the n-grams appear, and every
later grouping contains ``id``, so only the texts are shuffled, never their n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import parallel
from notewright.functions import align
from notewright.functions.text import (
    normalize_text,
    tokens_13a,
    tokens_alnum,
    with_sections,
    word_count,
)
from notewright.schema import SECTIONS


def _grams(tokens: Column, n: int, entry: Callable[[Column], Column]) -> Column:
    """``entry`` of each n-gram; of single tokens nothing is put together."""
    if n == 1:
        return F.transform(tokens, entry)
    n_grams = F.size(tokens) - n + 1
    places = F.when(n_grams > 0, F.sequence(F.lit(0), n_grams - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: entry(F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)])))


def ngram_counts(
    pairs: DataFrame,
    tokenizer: Callable[[Column], Column],
    orders: Sequence[int],
    keys: Sequence[str] = ("id",),
    cut_by_id: bool = True,
) -> DataFrame:
    """``keys…, n, gram, in_pred, in_ref``; a pair without n-grams keeps one null row.

    Pass ``cut_by_id=False`` for a pair table that is already partitioned by ``id``.
    """
    if cut_by_id:
        pairs = parallel.by_key(pairs, "id")
    cut = pairs.select(*keys, tokenizer(F.col("pred")).alias("p"), tokenizer(F.col("ref")).alias("r"))

    def entries(side: str, n: int) -> Column:
        is_pred = side == "p"
        return _grams(
            F.col(side),
            n,
            lambda g: F.struct(
                F.lit(n).alias("n"),
                g.alias("gram"),
                F.lit(int(is_pred)).alias("p"),
                F.lit(int(not is_pred)).alias("r"),
            ),
        )

    every = F.concat(*[entries(side, n) for side in ("p", "r") for n in orders])
    return (
        cut.select(*keys, F.inline_outer(every))
        .groupBy(*keys, "n", "gram")
        .agg(F.sum("p").alias("in_pred"), F.sum("r").alias("in_ref"))
    )


def ngram_matches(grams: DataFrame, orders: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Per pair and order ``n``: ``hit_n`` (clipped matches), ``pred_n`` and ``ref_n`` totals."""

    def total(n: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, value)), F.lit(0))

    clipped = F.least("in_pred", "in_ref")
    return grams.groupBy(*keys).agg(
        *[
            total(n, value).alias(f"{name}_{n}")
            for n in orders
            for name, value in (
                ("hit", clipped),
                ("pred", F.col("in_pred")),
                ("ref", F.col("in_ref")),
            )
        ]
    )


def bleu_from_totals() -> Column:
    """Corpus BLEU-4 from summed ``hit_n``, ``pred_n`` and ``ref_1``; no smoothing."""
    logs, positive = F.lit(0.0), F.lit(True)
    for n in (1, 2, 3, 4):
        positive = positive & (F.col(f"hit_{n}") > 0)
        logs = logs + F.log(F.col(f"hit_{n}") / F.col(f"pred_{n}"))
    short = F.col("pred_1") <= F.col("ref_1")
    penalty = F.when(short, F.exp(1.0 - F.col("ref_1") / F.col("pred_1"))).otherwise(1.0)
    return F.when(positive, penalty * F.exp(logs / 4)).otherwise(0.0)


def bleu_totals(
    pairs: DataFrame,
    group: Sequence[str] = (),
    keys: Sequence[str] = ("id",),
    tokenizer: Callable[[Column], Column] = tokens_13a,
    cut_by_id: bool = True,
) -> DataFrame:
    orders = (1, 2, 3, 4)
    per_pair = ngram_matches(
        ngram_counts(pairs, tokenizer, orders, keys, cut_by_id), orders, keys
    )
    sums = [
        F.coalesce(F.sum(f"{name}_{n}"), F.lit(0)).alias(f"{name}_{n}")
        for n in orders
        for name in ("hit", "pred", "ref")
    ]
    return per_pair.groupBy(*group).agg(F.count("*").alias("n_pairs"), *sums)


def bleu(
    pairs: DataFrame,
    group: Sequence[str] = (),
    keys: Sequence[str] = ("id",),
    cut_by_id: bool = True,
) -> DataFrame:
    """``group…, n_pairs, bleu, brevity, pred_len, ref_len``."""
    totals = bleu_totals(pairs, group, keys, cut_by_id=cut_by_id)
    ratio = F.when(F.col("ref_1") > 0, F.col("pred_1") / F.col("ref_1")).otherwise(0.0)
    return totals.select(
        *group,
        "n_pairs",
        F.round(bleu_from_totals(), 6).alias("bleu"),
        F.round(ratio, 6).alias("length_ratio"),
        F.col("pred_1").alias("pred_len"),
        F.col("ref_1").alias("ref_len"),
    )


def f_measure(hit: Column, n_pred: Column, n_ref: Column) -> Column:
    """2pr/(p+r) is 2·hit/(pred+ref); 0 without hits."""
    return F.when(hit > 0, 2.0 * hit / (n_pred + n_ref)).otherwise(0.0)


def rouge_n_scores(
    pairs: DataFrame,
    orders: Sequence[int] = (1, 2),
    keys: Sequence[str] = ("id",),
    cut_by_id: bool = True,
) -> DataFrame:
    """``keys…, rouge1, rouge2`` per pair."""
    matches = ngram_matches(
        ngram_counts(pairs, tokens_alnum, orders, keys, cut_by_id), orders, keys
    )
    return matches.select(
        *keys,
        *[
            f_measure(F.col(f"hit_{n}"), F.col(f"pred_{n}"), F.col(f"ref_{n}")).alias(f"rouge{n}")
            for n in orders
        ],
    )


def mean_scores(scores: DataFrame, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*group).agg(
        F.count("*").alias("n_pairs"),
        *[F.round(F.avg(n), 6).alias(n) for n in names],
    )


def rouge_n(pairs: DataFrame, group: Sequence[str] = (), keys: Sequence[str] = ("id",),
            cut_by_id: bool = True) -> DataFrame:
    return mean_scores(rouge_n_scores(pairs, (1, 2), keys, cut_by_id), ("rouge1", "rouge2"), group)


def rouge_l_scores(pairs: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return pairs.select(
        *keys,
        align.rouge_l("pred", "ref").alias("rougeL"),
        align.rouge_lsum("pred", "ref").alias("rougeLsum"),
    )


def rouge_l(pairs: DataFrame, group: Sequence[str] = (), keys: Sequence[str] = ("id",)) -> DataFrame:
    return mean_scores(rouge_l_scores(pairs, keys), ("rougeL", "rougeLsum"), group)


def meteor_exact(
    pairs: DataFrame, group: Sequence[str] = (), keys: Sequence[str] = ("id",)
) -> DataFrame:
    """Mean METEOR with exact and stem matches; without the synonym stage."""
    scores = pairs.select(*keys, align.meteor("pred", "ref").alias("meteor_exact"))
    return mean_scores(scores, ("meteor_exact",), group)


def section_rouge_scores(pairs: DataFrame, names: Sequence[str] = SECTIONS,
                         keys: Sequence[str] = ("id",)) -> DataFrame:
    """``keys…, section, rougeL`` per pair and section on normalised text."""
    cut = with_sections(pairs.select(*keys, "pred", "ref"), "pred", names, "p")
    cut = with_sections(cut, "ref", names, "r")
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("section"),
                normalize_text(F.col(f"p.`{n.lower()}`")).alias("pred"),
                normalize_text(F.col(f"r.`{n.lower()}`")).alias("ref"),
            )
            for n in names
        ]
    )
    long = cut.select(*keys, F.inline(rows))
    both_empty = (F.col("pred") == "") & (F.col("ref") == "")
    score = F.when(both_empty, 1.0).otherwise(align.rouge_l("pred", "ref"))
    return long.select(*keys, "section", score.alias("rougeL"))


def section_rouge(
    pairs: DataFrame, names: Sequence[str] = SECTIONS, group: Sequence[str] = (),
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    return section_rouge_scores(pairs, names, keys).groupBy(*group, "section").agg(
        F.round(F.avg("rougeL"), 4).alias("rougeL")
    )


def length_stats(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean words on both sides and the share of predictions over twice their reference."""
    counted = pairs.select(
        *group, word_count(F.col("pred")).alias("p"), word_count(F.col("ref")).alias("r")
    )
    is_long = (F.col("r") > 0) & (F.col("p") > 2 * F.col("r"))
    return counted.groupBy(*group).agg(
        F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 1).alias("avg_pred_length"),
        F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 1).alias("avg_ref_length"),
        F.round(F.count_if(is_long) / F.greatest(F.count("*"), F.lit(1)), 4).alias("over_2x_ratio"),
    )
