"""Entity listings and prompt tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import schema as S
from notewright import templates as T
from notewright.functions.text import is_blank, strip, text_or_empty, truncate_chars, words
from notewright.operators.entities import literal_array, literal_map


# ------------------------------------------------------------- entity listings


def entity_block(
    rows: DataFrame,
    entities: DataFrame,
    sections: Mapping[str, Sequence[str]] = S.SECTION_LABELS,
    empty: str = S.NO_ENTITIES,
) -> DataFrame:
    """``id, entity_block``: one ``Section: a, b`` line per section that has entities.

    Repeats of a text within a section (any case) are dropped before texts are gathered.
    """
    section_of = literal_map({lab: sec for sec, labs in sections.items() for lab in labs})
    listed = (
        entities.select("id", "pos", "text", F.try_element_at(section_of, F.lower("label")).alias("section"))
        .filter(F.col("section").isNotNull())
        .groupBy("id", "section", F.lower("text").alias("key"))
        .agg(F.min(F.struct("pos", "text")).alias("first"))
        .groupBy("id", "section")
        .agg(F.array_sort(F.collect_list("first")).alias("texts"))
        .select(
            "id",
            F.array_position(literal_array(list(sections)), F.col("section")).alias("place"),
            F.concat(
                "section", F.lit(": "), F.array_join(F.transform("texts", lambda t: t["text"]), ", ")
            ).alias("line"),
        )
    )
    return _join_lines(rows, listed, "entity_block", "", empty)


def _join_lines(rows: DataFrame, listed: DataFrame, name: str, prefix: str, empty: str) -> DataFrame:
    """At most one line per heading, so groups are small."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    blocks = listed.groupBy("id").agg(
        F.array_join(F.transform(ordered, lambda x: F.concat(F.lit(prefix), x["line"])), "\n").alias(name)
    )
    return rows.select("id").join(blocks, "id", "left").withColumn(name, F.coalesce(name, F.lit(empty)))


def entity_block_flat(
    rows: DataFrame,
    entities: DataFrame,
    headings: Sequence[tuple[str, str]] = S.FLAT_HEADINGS,
    empty: str = S.NO_ENTITIES_FLAT,
) -> DataFrame:
    """``id, entity_block``: a bullet per heading in fixed order; repeats stay.

    Drug qualifiers go to the medication line, after the drugs, kind by kind.
    """
    heading_of = {label: head for head, label in headings}
    order_in_line = {label: 0 for label in heading_of}
    for k, kind in enumerate(S.DRUG_QUALIFIERS, 1):
        heading_of[f"drug {kind}"] = heading_of.get("medication", "Medications")
        order_in_line[f"drug {kind}"] = k
    rank = F.create_map(*[F.lit(x) for kv in order_in_line.items() for x in kv])
    kind = F.regexp_extract("label", "^drug (" + "|".join(S.DRUG_QUALIFIERS) + ")$", 1)
    shown = F.when(kind != "", F.concat(F.lit("("), kind, F.lit(":"), F.col("text"), F.lit(")")))
    ordered = F.array_sort(F.collect_list(F.struct("within", "pos", "shown")))
    listed = (
        entities.select(
            "id",
            "pos",
            F.try_element_at(literal_map(heading_of), F.col("label")).alias("head"),
            F.try_element_at(rank, F.col("label")).alias("within"),
            shown.alias("qualified"),
            "text",
        )
        .filter(F.col("head").isNotNull())
        .withColumn("shown", F.coalesce("qualified", "text"))
        .groupBy("id", "head")
        .agg(F.array_join(F.transform(ordered, lambda t: t["shown"]), ", ").alias("texts"))
        .select(
            "id",
            F.array_position(literal_array([h for h, _ in headings]), F.col("head")).alias("place"),
            F.concat("head", F.lit(": "), "texts").alias("line"),
        )
    )
    return _join_lines(rows, listed, "entity_block", "- ", empty)


# ------------------------------------------------------------------- rendering


def render(template: str, **slots: Column) -> Column:
    """Fill the ``{name}`` slots of a layout with columns, null as empty text."""
    names = "|".join(slots)
    parts = re.split(r"\{(" + names + r")\}", template) if slots else [template]
    pieces = [
        text_or_empty(slots[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p
    ]
    return F.concat(*pieces)


def dialogue_prompt(train: bool = False, end_token: bool = False) -> Column:
    layout = T.DIALOGUE_TRAIN if train else T.DIALOGUE_INFER
    layout += T.END_TOKEN if train and end_token else ""
    slots = {"dialogue": strip(F.col("dialogue"))}
    if train:
        slots["note"] = strip(F.col("note"))
    return render(layout, **slots)


def entity_prompt(train: bool = False, entities: Column | None = None) -> Column:
    entities = F.col("entity_block") if entities is None else entities
    if train:
        return render(T.ENTITIES_TRAIN, entities=entities, dialogue=F.col("dialogue"), note=F.col("note"))
    return render(T.ENTITIES_INFER, entities=entities, dialogue=F.col("dialogue"))


def ablation_prompt() -> Column:
    """The entity prompt as if nothing had been extracted."""
    return entity_prompt(entities=F.lit(S.NO_ENTITIES))


def optional_entity_prompt(train: bool = False, entities: Column | None = None) -> Column:
    """The entity part is left out where there are no entities."""
    entities = F.col("entity_block") if entities is None else entities
    block = F.when(is_blank(entities), F.lit("")).otherwise(render(T.OPTIONAL_BLOCK, entities=entities))
    prompt = F.concat(F.lit(T.OPTIONAL_HEAD), block, render(T.OPTIONAL_TAIL, dialogue=F.col("dialogue")))
    if train:
        return F.concat(prompt, strip(text_or_empty(F.col("note"))), F.lit(T.END_TOKEN))
    return prompt


def combined_prompt(train: bool = False) -> Column:
    slots = {c: F.col(n) for c, n in (
        ("entities", "entity_block"), ("retrieved", "retrieved_note"), ("dialogue", "dialogue"))}
    if train:
        return render(T.COMBINED_TRAIN, note=F.col("note"), **slots)
    return render(T.COMBINED_INFER, **slots)


def extraction_prompt(max_chars: int = S.PROMPT_DIALOGUE_CHARS) -> Column:
    head = F.lit("[INST] " + T.EXTRACTION_RULES)
    return F.concat(head, render(T.EXTRACTION_TAIL, dialogue=truncate_chars(F.col("dialogue"), max_chars)))


def judge_prompt(gold: Column | None = None) -> Column:
    pieces = [render(T.JUDGE_HEAD, dialogue=F.col("dialogue"))]
    if gold is not None:
        has_gold = F.coalesce(gold, F.lit("")) != ""
        pieces.append(F.when(has_gold, render(T.JUDGE_GOLD, gold=gold)).otherwise(""))
    pieces += [render(T.JUDGE_NOTE, note=F.col("generated_note")), F.lit(T.JUDGE_TAIL)]
    return F.concat(*pieces)


def input_output_text() -> Column:
    return render(T.INPUT_OUTPUT, prompt=F.col("prompt"), target=F.col("target"))


def example_row(examples: DataFrame, ids: Sequence[int] = S.EXAMPLE_IDS) -> Column:
    """The few-shot examples as one scalar array of structs, in the order of ``ids``.

    Every prompt row reads the same small value, so no join is needed.
    """
    place = F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("id"))
    row = F.struct(place.alias("place"), "entity_block", "dialogue", "note")
    return (
        examples.filter(F.col("id").isin(*ids)).agg(F.array_sort(F.collect_list(row)).alias("examples")).scalar()
    )


def fewshot_prompt(
    examples: Column, with_entities: Sequence[bool] = (True, True), dialogue: Column | None = None
) -> Column:
    """Two worked examples, then the case. ``with_entities``: which examples list entities.

    Where no example does, the case does not either, and the plain instruction is used.
    """
    dialogue = F.col("dialogue") if dialogue is None else dialogue
    any_entities = any(with_entities)
    head = T.FEWSHOT_ENTITY_INSTRUCTION if any_entities else "[INST] " + T.NOTE_INSTRUCTION
    pieces = [F.lit(head + T.FEWSHOT_HEAD)]
    for k, listed in enumerate(with_entities):
        row = F.get(examples, F.lit(k))
        pieces.append(F.lit(T.FEWSHOT_EXAMPLE.replace("{number}", str(k + 1))))
        if listed:
            pieces.append(render(T.FEWSHOT_ENTITIES, entities=row["entity_block"]))
        pieces.append(render(T.FEWSHOT_DIALOGUE, dialogue=row["dialogue"]))
        pieces.append(render(T.FEWSHOT_NOTE, note=row["note"]))
    pieces.append(F.lit(T.FEWSHOT_CASE if any_entities else T.FEWSHOT_TASK))
    if any_entities:
        pieces.append(render(T.FEWSHOT_ENTITIES, entities=F.col("entity_block")))
    pieces += [render(T.FEWSHOT_DIALOGUE, dialogue=dialogue), F.lit(T.FEWSHOT_END)]
    return F.concat(*pieces)


def render_prompts(df: DataFrame, layouts: Mapping[str, Column]) -> DataFrame:
    """Long table ``id, layout, prompt``; the layouts are expressions over the columns of ``df``."""
    rows = F.array(*[F.struct(F.lit(n).alias("layout"), c.alias("prompt")) for n, c in layouts.items()])
    return df.select("id", F.inline(rows))


def fit_budget(
    df: DataFrame,
    prompt: Callable[[Column], Column],
    max_tokens: int = S.PROMPT_TOKEN_BUDGET,
    reserve: int = 50,
) -> DataFrame:
    """Render ``prompt(dialogue)``; over budget, keep fewer leading dialogue words and render again.

    Tokens are white-space words. Adds ``prompt``, ``n_tokens`` and ``n_kept`` (dialogue words).
    """
    whole = prompt(F.col("dialogue"))
    spoken = words(F.col("dialogue"))
    over = F.size(words(whole)) - max_tokens
    keep = F.greatest(F.lit(0), F.size(spoken) - over - reserve)
    shortened = prompt(F.array_join(F.slice(spoken, F.lit(1), keep), " "))
    fitted = F.when(over <= 0, whole).otherwise(shortened)
    return df.select(
        "id",
        fitted.alias("prompt"),
        F.size(words(fitted)).cast("long").alias("n_tokens"),
        F.when(over <= 0, F.size(spoken)).otherwise(keep).cast("long").alias("n_kept"),
    )
