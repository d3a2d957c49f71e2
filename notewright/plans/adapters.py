"""Bring the test tables into the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright import schema as S
from notewright.functions.text import text_or_empty
from notewright.operators.dialogues import assemble_dialogues
from notewright.operators.entities import (
    entities_json,
    literal_array,
    tag_lexicon,
)

ROLES = ("user", "assistant", "system")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )


def documents_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(vectors(spark, sf_dir), "id", "left")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_dialogues(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, dialogue, ref, pred`` per conversation: user text against assistant text."""
    turns = table(spark, sf_dir, "conversations")

    def said(role: str):
        mine = F.when(F.col("role") == role, F.struct("turn", "text"))
        ordered = F.array_sort(F.collect_list(mine))
        return F.array_join(F.transform(ordered, lambda t: t["text"]), "\n")

    line = F.struct("turn", F.concat(F.lit("["), "role", F.lit("]: "), text_or_empty(F.col("text"))).alias("line"))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(line)), lambda t: t["line"]), "\n"
        ).alias("dialogue"),
        said("user").alias("ref"),
        said("assistant").alias("pred"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the pairs, of whole texts: what the assistant said, the user, both."""
    variants = F.array(
        *[
            F.struct(F.lit(name).alias("config"), F.col(said).alias("pred"))
            for name, said in (("assistant", "pred"), ("user", "ref"), ("dialogue", "dialogue"))
        ]
    )
    return pairs(spark, sf_dir).select("id", "dialogue", "ref", F.inline(variants))


def _place():
    """An order of phrases that needs no sort: the first 48 bits of their MD5."""
    return F.conv(F.substring(F.md5("phrase"), 1, 12), 16, 10).cast("long").alias("ord")


def two_word_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, phrase, term``: every two adjacent words of ``benchmark``."""
    tokens = benchmark(spark, sf_dir).select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w"))
    after = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda word, i: F.concat_ws(" ", F.get("w", i), word))
    phrases = tokens.select(F.explode(after).alias("phrase")).distinct()
    return phrases.select(_place(), "phrase", F.upper("phrase").alias("term"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, phrase, label, score``: every word of ``benchmark``."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    every = benchmark(spark, sf_dir).select(F.explode(tokens).alias("phrase")).distinct()
    return every.select(_place(), "phrase").select(
        "ord",
        "phrase",
        F.get(literal_array(S.ENTITY_LABELS), (F.col("ord") % 10).cast("int")).alias("label"),
        F.least(F.lit(1.0), F.round(0.3 + (F.col("ord") % 8) / 10, 4)).alias("score"),
    )


def dialogue_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_lexicon(dialogues(spark, sf_dir), lexicon(spark, sf_dir), "dialogue")


def pred_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_lexicon(pairs(spark, sf_dir), lexicon(spark, sf_dir), "pred")


def ref_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_lexicon(pairs(spark, sf_dir), lexicon(spark, sf_dir), "ref")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_lexicon(documents(spark, sf_dir), lexicon(spark, sf_dir), "text")


def noisy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document entities as a careless extractor writes them: ``id, pos, text, label, score``."""
    text, turn = F.col("text"), F.col("pos") % 4
    spelled = (
        F.when(turn == 1, F.concat(F.lit("The my "), text))
        .when(turn == 2, F.upper(text))
        .when(turn == 3, F.concat(F.lit("i’ve been having "), text, F.lit(" ")))
        .otherwise(text)
    )
    label = F.col("label")
    renamed = (
        F.when(label == "follow-up instruction", "Follow-Up")
        .when(label == "test or lab order", " lab ")
        .when(label == "drug detail", "dosage")
        .when(label == "physical exam finding", "exam finding")
        .when(label == "referral", "somewhere else")
        .otherwise(label)
    )
    score = F.when(F.col("pos") % 6 != 5, F.col("score") * 1.25)
    return document_entities(spark, sf_dir).select(
        "id", "pos", spelled.alias("text"), renamed.alias("label"), score.alias("score")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, response``: the noisy entities as JSON in the shapes a language model returns."""
    cells = entities_json(noisy_entities(spark, sf_dir))
    body, shape = F.col("entities_json"), F.col("id") % 6
    wrapped = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("Here they are: "), body, F.lit(" Done.")))
        .when(shape == 2, F.concat(F.lit('[3, "x", {"text": "y"}, '), F.substring(body, F.lit(2), F.length(body))))
        .when(shape == 3, F.concat(F.lit('{"entities": '), body, F.lit("}")))
        .when(shape == 4, F.substring(body, F.lit(1), F.length(body) - 1))
        .otherwise(body)
    )
    return cells.select("id", wrapped.alias("response"))


def legacy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entities_json``: the noisy entities in an object beside other fields, as older tables hold them."""
    cells = entities_json(noisy_entities(spark, sf_dir))
    return cells.select("id", F.concat(F.lit('{"entities": '), "entities_json", F.lit(', "demographics": "[age, sex]"}')).alias("entities_json"))


def long_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``phrase, label, score``: every word and every two and three adjacent words of ``benchmark``."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)

    def runs(n: int):
        return F.transform("w", lambda _, i: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " ")))

    every = F.array_compact(F.concat(*(runs(n) for n in (1, 2, 3))))
    phrases = benchmark(spark, sf_dir).select(w.alias("w")).select(F.explode(every).alias("phrase")).distinct()
    return phrases.select(_place(), "phrase").select(
        "phrase",
        F.get(literal_array(S.ENTITY_LABELS), (F.col("ord") % 10).cast("int")).alias("label"),
        F.least(F.lit(1.0), F.round(0.3 + (F.col("ord") % 8) / 10, 4)).alias("score"),
    )


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entities_json`` for the labelled documents."""
    cell = F.format_string('[{"text": "quality %d", "label": "diagnosis"}]', F.col("quality"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), cell.alias("entities_json"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("text").alias("dialogue"), F.col("text").alias("note"))
    return docs.join(label_cells(spark, sf_dir), "id")


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("id", F.col("pred").alias("retrieved_note"))


def combined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label cell and retrieved note, null where there is none."""
    return (
        documents(spark, sf_dir)
        .join(label_cells(spark, sf_dir), "id", "left")
        .join(retrieved(spark, sf_dir), "id", "left")
    )
