"""Entity quality: precision and recall, grounding, usefulness, noise, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import parallel
from notewright import schema as S
from notewright.functions.text import normalize_text, text_or_empty, word_count
from notewright.operators.containment import held_words, occurrences
from notewright.operators.entities import entity_set_diff
from notewright.operators.quantiles import exact_quantiles
from notewright.session import stage


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _prf() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    return [
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        "tp",
        "fp",
        "fn",
    ]


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]


def entity_prf_all(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores per label plus one row with null label for the micro average; one pass."""
    return entity_set_diff(pred, gold).rollup("label").agg(*_sums()).select("label", *_prf())


def entity_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return entity_set_diff(pred, gold).agg(*_sums()).select(*_prf())


def entity_prf_by_label(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return entity_set_diff(pred, gold).groupBy("label").agg(*_sums()).select("label", *_prf())


# ------------------------------------------------------------------ grounding


def usefulness_rows(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """``id, score``: share of a document's entities whose text stands in its note."""
    lowered = notes.select("id", F.lower(text_or_empty(F.col("note"))).alias("note"))
    hit = F.contains(F.col("note"), F.lower(F.col("text")))
    return (
        entities.select("id", "text")
        .join(lowered, "id")
        .groupBy("id")
        .agg((F.count_if(hit) / F.count("*")).alias("score"))
    )


def usefulness(entities: DataFrame, notes: DataFrame) -> DataFrame:
    return usefulness_rows(entities, notes).agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean"),
        F.round(F.coalesce(F.percentile("score", 0.5), F.lit(0.0)), 6).alias("median"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("std"),
    )


def noise_ratio(
    entities: DataFrame, stoplist: Sequence[str] | DataFrame = S.BODY_PARTS
) -> DataFrame:
    """Mean share of entities that are a bare stoplist word of at most two words.

    ``stoplist``: words, or a table with a ``phrase`` column of distinct ones.
    """
    low = F.lower(F.col("text"))
    if isinstance(stoplist, DataFrame):
        listed = stoplist.select(F.col("phrase").alias("stop"))
        entities = entities.join(listed, low == F.col("stop"), "left")
        is_listed = F.col("stop").isNotNull()
    else:
        is_listed = low.isin(*stoplist)
    is_noise = (word_count(F.col("text")) <= 2) & is_listed
    return (
        entities.groupBy("id")
        .agg((F.count_if(is_noise) / F.count("*")).alias("ratio"))
        .agg(F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 6).alias("mean"))
    )


def all_keywords() -> list[str]:
    return [k for group in S.CLINICAL_KEYWORDS.values() for k in group]


def keyword_coverage(entities: DataFrame, notes: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """How much of the keywords in a note some entity of the document captures.

    ``keywords`` has a column ``word``; a word that stands in it twice counts twice, an
    empty one or an empty entity not at all. An entity captures a keyword that contains
    it or that it contains. Notes are searched by anchors (:func:`occurrences`); different keywords and entity texts are searched
    once each (:func:`held_words`). Rows of a note meet by groupings, and joins go by the size in memory (:func:`parallel.sent_if_small`): what is written
    between jobs is far larger there than in its file, so that a join might send it whole to the driver.
    """
    if keywords is None:
        fixed = F.array(*[F.lit(k) for k in all_keywords()])
        keywords = entities.sparkSession.range(1).select(F.explode(fixed).alias("word"))
    counted = keywords.filter("word <> ''").groupBy("word").agg(F.count("*").alias("weight"))
    lowered = notes.select("id", F.lower(text_or_empty(F.col("note"))).alias("low"))
    wanted = stage(occurrences(lowered, counted.select("word"), keep=["id"]), "wanted")
    texts = stage(entities.select("id", F.lower("text").alias("low")).filter("id is not null and low <> ''").distinct(), "entity-texts")
    as_texts, as_words = wanted.withColumnRenamed("word", "low"), texts.withColumnRenamed("low", "word")
    around = texts.join(parallel.sent_if_small(held_words(texts, wanted)), "low").select("id", "word")
    # An entity text asked for by a keyword that holds it, and whether the document has it.
    asks = as_texts.join(parallel.sent_if_small(held_words(as_texts, as_words)), "low").select("id", F.col("word").alias("text"), F.col("low").alias("word"))
    has = texts.select("id", F.col("low").alias("text"), F.lit(None).cast("string").alias("word"))
    inside = (
        asks.unionByName(has).groupBy("id", "text")
        .agg(F.collect_set("word").alias("words"), F.bool_or(F.col("word").isNull()).alias("there"))
        .filter("there").select("id", F.explode("words").alias("word"))
    )
    marked = wanted.select("id", "word", F.lit(True).alias("own")).unionByName(around.unionByName(inside).withColumn("own", F.lit(False)))
    per_note = (
        marked.groupBy("id", "word").agg(F.bool_or("own").alias("own"), F.bool_and("own").alias("missed"))
        .filter("own")
        .join(counted, "word")
        .groupBy("id")
        .agg((F.sum(F.when(~F.col("missed"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("score"))
    )
    return per_note.agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean"),
        F.count("*").alias("rows_evaluated"),
    )


def symptom_recall(
    dialogue_entities: DataFrame, notes: DataFrame, labels: Sequence[str] = S.SYMPTOM_LABELS,
    note: str = "pred",
) -> DataFrame:
    """Share of asserted symptoms of the dialogue whose text stands in the note."""
    found = (
        dialogue_entities.filter(
            F.col("label").isin(*labels) & ~F.coalesce("negated", F.lit(False))
        )
        .select("id", normalize_text(F.col("text")).alias("text"))
        .join(notes.select("id", normalize_text(F.col(note)).alias("note")), "id")
    )
    return found.agg(
        F.count("*").alias("n_symptoms"),
        F.count_if(F.contains("note", F.col("text"))).alias("n_covered"),
    ).select(
        "n_symptoms",
        "n_covered",
        F.round(_ratio(F.col("n_covered"), F.col("n_symptoms")), 4).alias("symptom_recall"),
    )


def grounding(note_entities: DataFrame, dialogue_entities: DataFrame) -> DataFrame:
    """``id, n_entities, n_ungrounded`` per note; multiplicity counts, negated ones too."""
    known = (
        dialogue_entities.select("id", normalize_text(F.col("text")).alias("text"))
        .distinct()
        .withColumn("known", F.lit(1))
    )
    said = note_entities.select("id", normalize_text(F.col("text")).alias("text")).groupBy(
        "id", "text"
    ).agg(F.count("*").alias("n"))
    return (
        said.join(known, ["id", "text"], "left")
        .groupBy("id")
        .agg(
            F.sum("n").alias("n_entities"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias(
                "n_ungrounded"
            ),
        )
    )


def hallucination_rate(note_entities: DataFrame, dialogue_entities: DataFrame) -> DataFrame:
    """Share of note entities whose text is no entity of the dialogue."""
    return (
        grounding(note_entities, dialogue_entities)
        .agg(
            F.coalesce(F.sum("n_entities"), F.lit(0)).alias("n_generated"),
            F.coalesce(F.sum("n_ungrounded"), F.lit(0)).alias("n_hallucinated"),
        )
        .withColumn(
            "hallucination_rate",
            F.round(_ratio(F.col("n_hallucinated"), F.col("n_generated")), 4),
        )
    )


# -------------------------------------------------------------- distributions


def label_distribution(entities: DataFrame) -> DataFrame:
    """``label, n, pct``; the window runs over the handful of labels, not over entities."""
    counts = entities.groupBy("label").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", F.round(share, 4).alias("pct")).orderBy(
        F.col("n").desc(), "label"
    )


def _buckets(value: Column, spec: Sequence[tuple[str, Column]]) -> list[Column]:
    counts = [F.count_if(cond).alias(name) for name, cond in spec]
    shares = [
        F.round(F.try_divide(100.0 * F.count_if(cond), F.count(value)), 1).alias(f"{name}_pct")
        for name, cond in spec
    ]
    return counts + shares


def span_lengths(entities: DataFrame) -> DataFrame:
    n = F.col("n")
    spec = (
        ("words_1", n == 1),
        ("words_2", n == 2),
        ("words_3_4", n.between(3, 4)),
        ("words_5_7", n.between(5, 7)),
        ("words_over_7", n > 7),
    )
    return entities.select(word_count(F.col("text")).alias("n")).agg(
        F.round(F.avg("n"), 2).alias("mean"),
        F.percentile("n", 0.5).alias("median"),
        F.min("n").alias("min"),
        F.max("n").alias("max"),
        F.count("*").alias("total_spans"),
        *_buckets(n, spec),
    )


def confidence_stats(entities: DataFrame) -> DataFrame:
    """One row about all scores; a null score counts as 0. Runs jobs at once: see :mod:`notewright.operators.quantiles`."""
    s = F.col("score")
    spec = (
        ("below_03", s < 0.3),
        ("from_03_to_05", (s >= 0.3) & (s < 0.5)),
        ("from_05_to_07", (s >= 0.5) & (s < 0.7)),
        ("from_07_to_09", (s >= 0.7) & (s < 0.9)),
        ("from_09", s >= 0.9),
    )
    # Scores are stored, as the median is found by narrowing ranges: unrounded scores may all differ.
    scores = stage(entities.select(F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    median = exact_quantiles(scores, "score", [0.5])[0]
    return scores.agg(
        F.round(F.avg("score"), 4).alias("mean"),
        F.round(F.lit(median).cast("double"), 4).alias("median"),
        F.round(F.min("score"), 4).alias("min"),
        F.round(F.max("score"), 4).alias("max"),
        F.count_distinct(F.round("score", 4)).alias("n_distinct"),
        (F.count_distinct(F.round("score", 4)) == 1).alias("all_identical"),
        *[F.count_if(cond).alias(name) for name, cond in spec],
    )


def split_summary(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows, mean entities per row, mean of the rows' lowest and highest score."""
    per_row = entities.groupBy("id").agg(
        F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")
    )
    return rows.select("id").join(per_row, "id", "left").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("avg_entities"),
        F.round(F.coalesce(F.avg("low"), F.lit(0.0)), 4).alias("avg_min_score"),
        F.round(F.coalesce(F.avg("high"), F.lit(0.0)), 4).alias("avg_max_score"),
    )


def combined_stats(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """``rows`` has ``id, retrieved_note``: entities per dialogue and retrieved length."""
    per_row = entities.groupBy("id").agg(F.count("*").alias("n"))
    return rows.select("id", "retrieved_note").join(per_row, "id", "left").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("avg_entities"),
        F.round(F.avg(F.length("retrieved_note")), 4).alias("avg_retrieved_chars"),
    )
