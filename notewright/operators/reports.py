"""Corpus reports, run comparison, leaderboards and best-of-N selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import parallel
from notewright import schema as S
from notewright.functions import align
from notewright.functions.text import (
    normalize_text,
    section_flags,
    text_or_empty,
    with_sections,
    word_count,
)
from notewright.operators import entityscores as ES
from notewright.operators import textscores as TS
from notewright.schema import SECTIONS


def structure_report(
    notes: DataFrame, note: str = "note", names: Sequence[str] = SECTIONS, group: Sequence[str] = ()
) -> DataFrame:
    """Percent of notes with each header and with all of them; 0 for no notes."""
    fields = [n.lower() for n in names] + ["all_headers"]
    flagged = notes.select(*group, section_flags(F.col(note), names).alias("has"))

    def percent(field: str) -> Column:
        share = 100.0 * F.count_if(F.col(f"has.`{field}`")) / F.greatest(F.count("*"), F.lit(1))
        return F.round(share, 2).alias(f"pct_{field}")

    return flagged.groupBy(*group).agg(F.count("*").alias("n_notes"), *[percent(f) for f in fields])


def corpus_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per text column: characters (mean, median, 95 %), words and sentences (mean)."""
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), text_or_empty(F.col(c)).alias("t")) for c in cols]
    )
    long = df.select(F.inline(rows))
    sentences = F.size(F.regexp_extract_all("t", F.lit(r"[^.!?\n]*[A-Za-z0-9][^.!?\n]*"), 0))
    return (
        long.select(
            "column_name",
            F.length("t").alias("chars"),
            word_count(F.col("t")).alias("words"),
            sentences.alias("sentences"),
        )
        .groupBy("column_name")
        .agg(
            F.count("*").alias("n_rows"),
            F.round(F.avg("chars"), 4).alias("mean_chars"),
            F.percentile("chars", 0.5).alias("median_chars"),
            F.round(F.percentile("chars", 0.95), 4).alias("p95_chars"),
            F.round(F.avg("words"), 4).alias("mean_words"),
            F.round(F.avg("sentences"), 4).alias("mean_sentences"),
        )
    )


def to_long(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``group…, metric, value`` from a wide report."""
    names = [c for c in report.columns if c not in group]
    cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    return report.select(*group, F.inline(cells))


ALIGNED = ("rougeL", "rougeLsum", "meteor_exact")


def _row_local(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Scores that need only the row itself, in one pass."""
    return pairs.select(
        *group,
        align.rouge_l("pred", "ref").alias("rougeL"),
        align.rouge_lsum("pred", "ref").alias("rougeLsum"),
        align.meteor("pred", "ref").alias("meteor_exact"),
    ).groupBy(*group).agg(*[F.round(F.avg(c), 6).alias(c) for c in ALIGNED])


def sweep_report(
    runs: DataFrame,
    gold: DataFrame,
    config: str = "config",
    aligned: bool = False,
    cut_by_id: bool = True,
) -> DataFrame:
    """One row per run with all text scores; all runs in one job.

    ``runs``: ``config, id, generated_note``; ``gold``: ``id, note``. ``aligned`` adds
    ROUGE-L and METEOR, the scores that leave the JVM.
    """
    keys = [config, "id"]
    pairs = runs.select(*keys, text_or_empty(F.col("generated_note")).alias("pred")).join(
        gold.select("id", text_or_empty(F.col("note")).alias("ref")), "id"
    )
    if cut_by_id:
        pairs = parallel.by_key(pairs, "id")
    n_gold = gold.agg(F.count("*").alias("n")).scalar()
    scores = TS.bleu(pairs, [config], keys, cut_by_id=False).select(config, "n_pairs", "bleu")
    parts = [
        TS.rouge_n(pairs, [config], keys, cut_by_id=False).drop("n_pairs"),
        TS.length_stats(pairs, [config]),
        pairs.groupBy(config).agg(
            F.round(F.avg(F.length("pred")), 4).alias("avg_pred_chars"),
            F.round(F.avg(F.length("ref")), 4).alias("avg_ref_chars"),
        ),
    ]
    if aligned:
        parts.append(_row_local(pairs, [config]))
    for part in parts:
        scores = scores.join(part, config)
    return scores.withColumn("coverage", F.round(100.0 * F.col("n_pairs") / n_gold, 4))


def compare_runs(report: DataFrame, before: str, after: str, config: str = "config") -> DataFrame:
    """``metric, before, after, delta`` from two rows of a sweep report."""
    return (
        to_long(report.filter(F.col(config).isin(before, after)), [config])
        .groupBy("metric")
        .agg(
            F.max(F.when(F.col(config) == before, F.col("value"))).alias("before"),
            F.max(F.when(F.col(config) == after, F.col("value"))).alias("after"),
        )
        .withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
    )


def leaderboard(
    report: DataFrame, baseline: str, metric: str = "bleu", config: str = "config"
) -> DataFrame:
    """Runs ranked by ``metric``, with the distance to the named baseline run."""
    # One row per run: the report is small whatever the size of the runs.
    order = Window.partitionBy().orderBy(F.col(metric).desc())
    base = F.max(F.when(F.col(config) == baseline, F.col(metric))).over(Window.partitionBy())
    return report.select(
        F.rank().over(order).cast("long").alias("place"),
        config,
        metric,
        F.round(F.col(metric) - base, 6).alias("delta"),
    ).orderBy("place", config)


def candidate_scores(
    candidates: DataFrame,
    entities: DataFrame,
    gold: DataFrame,
    names: Sequence[str] = SECTIONS,
    config: str = "config",
) -> DataFrame:
    """``config, id, entity_recall, header_share, length_score, score`` per candidate note.

    Mean of: share of the id's distinct entity texts in the note (1 without entities),
    share of headers, and 1 minus the relative distance to the median gold length
    (at least 0).
    """
    median = gold.agg(F.percentile(F.length(text_or_empty(F.col("note"))), 0.5).alias("m")).scalar()
    note = text_or_empty(F.col("generated_note"))
    flags = section_flags(note, names)
    present = sum((flags[n.lower()].cast("int") for n in names), F.lit(0))
    length_score = F.greatest(
        F.lit(0.0), 1.0 - F.abs(F.length(note) - median) / F.greatest(median, F.lit(1.0))
    )
    local = candidates.select(
        config,
        "id",
        (present / len(names)).alias("header_share"),
        length_score.alias("length_score"),
    )
    wanted = entities.select("id", normalize_text(F.col("text")).alias("text")).distinct()
    recall = (
        candidates.select(config, "id", normalize_text(note).alias("note"))
        .join(wanted, "id")
        .groupBy(config, "id")
        .agg((F.count_if(F.contains("note", F.col("text"))) / F.count("*")).alias("recall"))
    )
    mean = (F.col("entity_recall") + F.col("header_share") + F.col("length_score")) / 3
    return (
        local.join(recall, [config, "id"], "left")
        .withColumn("entity_recall", F.coalesce("recall", F.lit(1.0)))
        .select(
            config,
            "id",
            *[F.round(c, 6).alias(c) for c in ("entity_recall", "header_share", "length_score")],
            F.round(mean, 6).alias("score"),
        )
    )


def best_of_n(
    candidates: DataFrame,
    entities: DataFrame,
    gold: DataFrame,
    names: Sequence[str] = SECTIONS,
    config: str = "config",
) -> DataFrame:
    """``id, config, score, generated_note`` of the best candidate; ties: lowest config."""
    scored = candidate_scores(candidates, entities, gold, names, config)
    chosen = scored.groupBy("id").agg(
        F.min_by(F.struct(config, "score"), F.struct(-F.col("score"), F.col(config))).alias("best")
    ).select("id", f"best.{config}", "best.score")
    return chosen.join(candidates.select(config, "id", "generated_note"), [config, "id"]).select(
        "id", config, "score", "generated_note"
    )


def full_report(
    pairs: DataFrame,
    pred_entities: DataFrame | None = None,
    gold_entities: DataFrame | None = None,
    dialogue_entities: DataFrame | None = None,
    names: Sequence[str] = SECTIONS,
    symptom_labels: Sequence[str] | None = None,
    normalize: bool = True,
    aligned: bool = True,
    cut_by_id: bool = True,
) -> DataFrame:
    """Every metric of a run as ``metric, value``; null where its input is missing.

    Text scores use normalised text unless ``normalize`` is off; structure, sections and
    lengths always use the text as it is. ``aligned`` includes ROUGE-L and METEOR.
    """
    if cut_by_id:
        pairs = parallel.by_key(pairs, "id")
    compared = pairs
    if normalize:
        compared = pairs.select(
            "id", normalize_text(F.col("pred")).alias("pred"), normalize_text(F.col("ref")).alias("ref")
        )
    parts = [
        to_long(TS.bleu(compared, cut_by_id=False).select("bleu")),
        to_long(TS.rouge_n(compared, cut_by_id=False).drop("n_pairs")),
        to_long(structure_report(pairs, "pred", names)),
        to_long(TS.length_stats(pairs)),
    ]
    if aligned:
        parts.append(to_long(_row_local(compared, [])))
        sections = TS.section_rouge(pairs, names)
        parts.append(
            sections.select(
                F.concat(F.lit("section_rougeL_"), F.lower("section")).alias("metric"),
                F.col("rougeL").alias("value"),
            )
        )
    absent = []
    if pred_entities is not None and gold_entities is not None:
        parts.append(_entity_rows(ES.entity_prf_all(pred_entities, gold_entities)))
    else:
        absent += ["entity_precision", "entity_recall", "entity_f1"]
    if pred_entities is not None and dialogue_entities is not None:
        parts.append(
            to_long(ES.hallucination_rate(pred_entities, dialogue_entities).select("hallucination_rate"))
        )
        extra = {"labels": symptom_labels} if symptom_labels else {}
        parts.append(to_long(ES.symptom_recall(dialogue_entities, pairs, **extra).select("symptom_recall")))
    else:
        absent += ["hallucination_rate", "symptom_recall"]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    if absent:
        spark = pairs.sparkSession
        report = report.unionByName(
            spark.createDataFrame([(m, None) for m in absent], "metric string, value double")
        )
    return report


def _entity_rows(prf: DataFrame) -> DataFrame:
    """``metric, value`` of the micro scores, and of each label's as ``entity_f1[label]`` and the like; one rollup gives both."""
    scores = ("precision", "recall", "f1")
    cells = F.array(
        *[F.struct(F.lit(f"entity_{c}" if c in scores else c).alias("metric"), F.col(c).cast("double").alias("value")) for c in (*scores, "tp", "fp", "fn")]
    )
    name = F.when(F.col("label").isNull(), F.col("metric")).otherwise(F.concat("metric", F.lit("["), "label", F.lit("]")))
    return prf.select("label", F.inline(cells)).select(name.alias("metric"), "value")


@dataclass(frozen=True)
class Gate:
    """``metric`` must be at least, below or at most ``bound``; one that only warns does not fail a run."""

    metric: str
    test: str  # one of ">=", "<", "<="
    bound: float
    warns: bool = False


# The first two decide, the others point at spans that cleaning missed and at scores that say nothing.
GATES = (
    Gate("usefulness_mean", ">=", 0.70),
    Gate("noise_mean", "<", 0.10),
    Gate("spans_over_7_words", "<=", 0, warns=True),
    Gate("all_scores_identical", "<=", 0, warns=True),
)


def quality_gates(
    entities: DataFrame, notes: DataFrame, stoplist: Sequence[str] | DataFrame = S.BODY_PARTS, gates: Sequence[Gate] = GATES
) -> DataFrame:
    """``gate, metric, value, test, bound, verdict`` (PASS, FAIL or WARN): each constraint on the entities' quality, one row each.

    All metrics come from one pass: per document, then over all. ``usefulness_mean``, ``usefulness_std``, ``noise_mean``: as in the operators of these names, a document without a
    note counting for noise alone. ``n_entities``, ``mean_words``, ``spans_over_7_words``, ``mean_score``, ``min_score``, ``max_score``, ``all_scores_identical``. No entities: every value is 0.
    """
    lowered = notes.select("id", F.lower(text_or_empty(F.col("note"))).alias("note"))
    low, words = F.lower(F.col("text")), word_count(F.col("text"))
    if isinstance(stoplist, DataFrame):
        entities = entities.join(stoplist.select(F.col("phrase").alias("stop")).distinct(), low == F.col("stop"), "left")
        listed = F.col("stop").isNotNull()
    else:
        listed = low.isin(*stoplist)
    score = F.round(F.coalesce("score", F.lit(0.0)), 4)
    per_document = (
        entities.join(lowered, "id", "left")
        .groupBy("id")
        .agg(
            F.count("*").alias("n"),
            F.when(F.count("note") > 0, F.count_if(F.contains("note", low)) / F.count("*")).alias("useful"),
            (F.count_if((words <= 2) & listed) / F.count("*")).alias("noise"),
            F.sum(words).alias("words"),
            F.count_if(words > 7).alias("long"),
            F.sum(score.cast("decimal(38,4)")).alias("scores"),
            F.min(score).alias("least"),
            F.max(score).alias("most"),
        )
    )
    metrics = {
        "usefulness_mean": F.avg("useful"),
        "usefulness_std": F.stddev_samp("useful"),
        "noise_mean": F.avg("noise"),
        "n_entities": F.sum("n"),
        "mean_words": F.sum("words") / F.sum("n"),
        "spans_over_7_words": F.sum("long"),
        "mean_score": F.sum("scores").cast("double") / F.sum("n"),
        "min_score": F.min("least"),
        "max_score": F.max("most"),
        "all_scores_identical": (F.min("least") == F.max("most")).cast("int"),
    }
    unknown = [g.metric for g in gates if g.metric not in metrics] + [g.test for g in gates if g.test not in (">=", "<", "<=")]
    if unknown:
        raise ValueError(f"unknown metrics or tests {unknown}")
    row = per_document.agg(*[F.round(F.coalesce(m.cast("double"), F.lit(0.0)), 6).alias(name) for name, m in metrics.items()])

    def judged(k: int, gate: Gate) -> Column:
        value, bound = F.col(gate.metric), F.lit(float(gate.bound))
        good = {">=": value >= bound, "<": value < bound, "<=": value <= bound}[gate.test]
        verdict = F.when(good, "PASS").otherwise("WARN" if gate.warns else "FAIL")
        return F.struct(
            F.lit(k).cast("long").alias("gate"), F.lit(gate.metric).alias("metric"), value.alias("value"), F.lit(gate.test).alias("test"), bound.alias("bound"), verdict.alias("verdict")
        )

    return row.select(F.inline(F.array(*[judged(k, g) for k, g in enumerate(gates)])))


def section_table(notes: DataFrame, note: str = "note", names: Sequence[str] = SECTIONS) -> DataFrame:
    """``id, section, body`` rows of each note."""
    cut = with_sections(notes.select("id", note), note, names, "s")
    rows = F.array(
        *[F.struct(F.lit(n).alias("section"), F.col(f"s.`{n.lower()}`").alias("body")) for n in names]
    )
    return cut.select("id", F.inline(rows))
