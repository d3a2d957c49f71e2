"""The batch transforms, run over files as they arrive, and dialogues put together from turns that arrive in several files.

Each new file is handled once: the checkpoint remembers which were read, and the file
sink commits whole batches, so a lost executor or a restart neither skips nor repeats one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.operators.dialogues import dialogue_text
from notewright.operators.entities import canonical_label, clean_spans, parse_entities, tag_words

DIALOGUE_FILES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("dialogue", T.StringType())]
)
TURN_FILES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)
RESPONSE_FILES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("response", T.StringType())]
)


def read_arriving(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
    max_files_per_batch: int = 1000,
) -> DataFrame:
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(folder)
    )


def run_available(
    arriving: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint: str,
    trigger: dict | None = None,
):
    """Start the job; by default it ends when all files present have been handled.

    ``transform`` is a stateless function of rows, such as :func:`tag_stream`.
    """
    return (
        transform(arriving)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_tag(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, lexicon: DataFrame, max_words: int = 1
):
    """Tag arriving dialogues with a lexicon: a stream joined to a static table."""
    arriving = read_arriving(spark, in_dir, DIALOGUE_FILES)
    return run_available(
        arriving, lambda df: tag_words(df, lexicon, "dialogue", max_words), out_dir, checkpoint
    )


def stream_parse(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str):
    """Parse, relabel and clean arriving extraction responses."""
    arriving = read_arriving(spark, in_dir, RESPONSE_FILES)
    return run_available(
        arriving, lambda df: clean_spans(canonical_label(parse_entities(df))), out_dir, checkpoint
    )


def closed_dialogues(turns: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """``id, dialogue, begin, end`` of the conversations in a stream of turns (conv_id, turn, role, text, at), each once, when it is over.

    The turns of a conversation wait in keyed state, in whatever files and order they come, until none has come for ``gap`` and the watermark (the latest time
    seen, less ``delay``) has passed that point. A turn that is older than the watermark when it arrives is late: it is dropped and counted in the
    query's progress (``numRowsDroppedByWatermark``). A turn after a longer silence than ``gap`` begins another dialogue of the same id. Within a dialogue the result is that of
    ``assemble_dialogues``. Turns without a time or conversation are dropped. Works on a table as well, where every dialogue is over.
    """
    timed = turns.filter("at is not null and conv_id is not null").withWatermark("at", delay)
    return (
        timed.groupBy(F.col("conv_id").alias("id"), F.session_window("at", gap).alias("session"))
        .agg(dialogue_text("role", "text").alias("dialogue"))
        .select("id", "dialogue", F.col("session.start").alias("begin"), F.col("session.end").alias("end"))
    )


def stream_dialogues(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 hour", max_files_per_batch: int = 1000
):
    """:func:`closed_dialogues` over arriving files of turns."""
    arriving = read_arriving(spark, in_dir, TURN_FILES, max_files_per_batch=max_files_per_batch)
    return run_available(arriving, lambda df: closed_dialogues(df, gap, delay), out_dir, checkpoint)
