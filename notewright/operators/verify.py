"""Rule-based checks of generated notes, and correction of the failing ones.

The five dimensions keep their published names; their formulas are this repo's own
(see each function). Without evidence for a dimension its score is 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import parallel
from notewright import schema as S
from notewright.functions.text import (
    compose_note,
    normalize_text,
    with_sections,
)
from notewright.operators.entities import literal_map

DIMENSIONS = ("faithfulness", "negation", "completeness", "consistency", "appropriateness")


def consistency_score(sections: Column, begins: Column, names: Sequence[str] = S.SECTIONS) -> Column:
    """Share of sections that have a header, a body, and stand after all earlier headers."""
    total = F.lit(0)
    for k, name in enumerate(names):
        earlier = F.coalesce(F.array_max(F.slice(begins, 1, k)), F.lit(-1)) if k else F.lit(-1)
        good = (begins[k] >= earlier) & (sections[name.lower()] != "")
        total = total + F.when(good, 1).otherwise(0)
    return total / len(names)


def _home(sections: Mapping[str, Sequence[str]]) -> Column:
    return literal_map({lab: sec.lower() for sec, labs in sections.items() for lab in labs})


def _facts(dialogue_entities: DataFrame, note_entities: DataFrame, sections: Mapping[str, Sequence[str]]) -> DataFrame:
    """``id, facts``: per document one entry for each normalised entity text, with what the dialogue and the note say of it.

    ``said``, ``denied``: the dialogue has it, has it negated; ``asserted``, ``n_note``: the note has it, not negated, and how often; ``placed_k``: how often with a label of
    section k; ``wanted_k``: the dialogue asserts it with such a label. One shuffle by document. A null ``negated`` is not negated.
    """
    home = F.try_element_at(_home(sections), F.lower("label"))
    columns = [F.col("id"), normalize_text(F.col("text")).alias("text"), home.alias("home"), F.coalesce("negated", F.lit(False)).alias("negated")]
    both = dialogue_entities.select(*columns, F.lit(True).alias("spoken")).unionByName(note_entities.select(*columns, F.lit(False).alias("spoken")))
    spoken, negated = F.col("spoken"), F.col("negated")
    per_text = (
        parallel.by_key(both, "id")
        .groupBy("id", "text")
        .agg(
            F.bool_or(spoken).alias("said"),
            F.bool_or(spoken & negated).alias("denied"),
            F.bool_or(~spoken & ~negated).alias("asserted"),
            F.count_if(~spoken).alias("n_note"),
            *[F.count_if(~spoken & (F.col("home") == n.lower())).alias(f"placed_{k}") for k, n in enumerate(sections)],
            *[F.coalesce(F.bool_or(spoken & ~negated & (F.col("home") == n.lower())), F.lit(False)).alias(f"wanted_{k}") for k, n in enumerate(sections)],
        )
    )
    return per_text.groupBy("id").agg(F.collect_list(F.struct(*[c for c in per_text.columns if c != "id"])).alias("facts"))


def verified_notes(
    notes: DataFrame,
    dialogue_entities: DataFrame,
    note_entities: DataFrame,
    threshold: float = 0.6,
    sections: Mapping[str, Sequence[str]] = S.SECTION_LABELS,
) -> DataFrame:
    """Scores and correction of each note (``id, note``) in one pass over its facts.

    ``faithfulness``: share of the note's entities that the dialogue has. ``negation``: share of the dialogue's denied texts that the note does not assert. ``completeness``: share of
    the dialogue's texts that stand in the note. ``appropriateness``: share of the note's entities that stand in the section of their label. ``consistency``:
    :func:`consistency_score`. A note that fails is set in the strict layout, and the asserted entities that it lacks are added to the section of their label, in order of text.
    """
    names = list(sections)
    none = F.expr("filter(facts, f -> false)")
    cut = with_sections(notes.select("id", "note"), "note", names).join(_facts(dialogue_entities, note_entities, sections), "id", "left")
    known = cut.withColumns(
        {
            "_low": normalize_text(F.col("note")),
            "_bodies": F.array(*[normalize_text(F.col("sections")[n.lower()]) for n in names]),
        }
    )
    facts, low, bodies = F.col("facts"), F.col("_low"), F.col("_bodies")

    def number(test) -> Column:
        return F.coalesce(F.size(F.filter(facts, test)), F.lit(0))

    def total(value) -> Column:
        return F.coalesce(F.aggregate(facts, F.lit(0).cast("long"), lambda acc, f: acc + value(f)), F.lit(0))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(1.0)

    def placed(f: Column) -> Column:
        return sum((F.when(F.contains(bodies[k], f["text"]), f[f"placed_{k}"]).otherwise(0) for k in range(len(names))), F.lit(0).cast("long"))

    n_note = total(lambda f: f["n_note"])
    scored = known.withColumns(
        {
            "faithfulness": F.when(n_note > 0, 1.0 - total(lambda f: F.when(f["said"], 0).otherwise(f["n_note"])) / n_note).otherwise(1.0),
            "negation": share(number(lambda f: f["denied"] & ~f["asserted"]), number(lambda f: f["denied"])),
            "completeness": share(number(lambda f: f["said"] & F.contains(low, f["text"])), number(lambda f: f["said"])),
            "consistency": consistency_score(F.col("sections"), F.col("sections_begin"), names),
            "appropriateness": share(total(placed), n_note),
        }
    )
    overall = sum((F.col(d) for d in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS)
    scored = scored.withColumn("overall_score", F.round(overall, 6)).withColumn("passed", F.col("overall_score") >= threshold)

    def lacking(k: int) -> Column:
        found = F.filter(F.coalesce(facts, none), lambda f: f[f"wanted_{k}"] & ~F.contains(low, f["text"]))
        return F.array_sort(F.transform(found, lambda f: f["text"]))

    def completed(k: int, name: str) -> Column:
        body, add = F.col("sections")[name.lower()], F.coalesce(F.array_join(F.col(f"_add_{k}"), ", "), F.lit(""))
        return F.concat_ws("\n", F.when(body != "", body), F.when(add != "", add))

    scored = scored.withColumns({f"_add_{k}": F.when(~F.col("passed"), lacking(k)) for k in range(len(names))})
    corrected = compose_note([completed(k, n) for k, n in enumerate(names)], names)
    n_added = sum((F.coalesce(F.size(f"_add_{k}"), F.lit(0)) for k in range(len(names))), F.lit(0))
    return scored.select(
        "id",
        *[F.round(d, 6).alias(d) for d in DIMENSIONS],
        "overall_score",
        "passed",
        F.when(F.col("passed"), F.col("note")).otherwise(corrected).alias("generated_note"),
        F.when(F.col("passed"), 0).otherwise(F.greatest(n_added, F.lit(0))).cast("long").alias("corrections_applied"),
    )


def verify_notes(
    notes: DataFrame,
    dialogue_entities: DataFrame,
    note_entities: DataFrame,
    threshold: float = 0.6,
    sections: Mapping[str, Sequence[str]] = S.SECTION_LABELS,
) -> DataFrame:
    """One row per note (``id, note``): five scores, their mean, and whether it passes; see :func:`verified_notes`."""
    return verified_notes(notes, dialogue_entities, note_entities, threshold, sections).drop("generated_note", "corrections_applied")


def apply_correction(
    notes: DataFrame,
    verified: DataFrame,
    dialogue_entities: DataFrame,
    sections: Mapping[str, Sequence[str]] = S.SECTION_LABELS,
) -> DataFrame:
    """``id, generated_note, corrections_applied``: failing notes recomposed and completed, for scores made elsewhere.

    A failing note is set in the strict layout; asserted entities it lacks are added to
    the section of their label, in order of text.
    """
    names = list(sections)
    home = F.try_element_at(_home(sections), F.lower("label"))
    failing = notes.join(verified.filter(~F.col("passed")).select("id"), "id", "left_semi")
    missing = (
        dialogue_entities.filter(~F.coalesce("negated", F.lit(False)))
        .select("id", home.alias("home"), normalize_text(F.col("text")).alias("text"))
        .filter(F.col("home").isNotNull())
        .distinct()
        .join(failing.select("id", normalize_text(F.col("note")).alias("low")), "id")
        .filter(~F.contains("low", F.col("text")))
        .groupBy("id")
        .agg(
            F.count("*").alias("n"),
            *[
                F.array_join(
                    F.array_sort(F.collect_list(F.when(F.col("home") == n.lower(), F.col("text")))), ", "
                ).alias(f"add_{i}")
                for i, n in enumerate(names)
            ],
        )
    )
    bodies = F.col("sections")

    def completed(i: int, name: str) -> Column:
        body, add = bodies[name.lower()], F.coalesce(F.col(f"add_{i}"), F.lit(""))
        return F.concat_ws("\n", F.when(body != "", body), F.when(add != "", add))

    corrected = compose_note([completed(i, n) for i, n in enumerate(names)], names)
    return (
        with_sections(notes.select("id", "note"), "note", names)
        .join(verified.select("id", "passed"), "id")
        .join(missing, "id", "left")
        .select(
            "id",
            F.when(F.col("passed"), F.col("note")).otherwise(corrected).alias("generated_note"),
            F.coalesce("n", F.lit(0)).cast("long").alias("corrections_applied"),
        )
    )


def verification_report(verified: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """One row: totals, pass rate, mean scores and, if ``corrected`` is given or ``verified`` has them, the corrections made."""
    rows = verified
    if corrected is None and "corrections_applied" in verified.columns:
        pass
    elif corrected is not None:
        rows = verified.join(corrected.select("id", "corrections_applied"), "id", "left")
    else:
        rows = verified.withColumn("corrections_applied", F.lit(0))
    return rows.agg(
        F.count("*").alias("n_notes"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        F.round(100.0 * F.count_if("passed") / F.greatest(F.count("*"), F.lit(1)), 4).alias("pct_passed"),
        F.round(F.avg("overall_score"), 4).alias("mean_overall"),
        *[F.round(F.avg(d), 4).alias(f"mean_{d}") for d in DIMENSIONS],
        F.coalesce(F.sum("corrections_applied"), F.lit(0)).alias("n_corrections"),
    )
