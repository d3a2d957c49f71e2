"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Every step reads less than the one before and shuffles counts only. What a step found
reaches the next as a broadcast of hash buckets that hold two rows or more: at most
65,536 for lengths and 262,144 for prefixes, at any input size. A bucket may let a row
through that has no partner; the hash of the whole text then settles it exactly.

Null texts are empty texts. A row with a null doc_id stays only if no other row of its
group has an id. Rows that agree in doc_id and text count one by one in ``group_size``;
one of them stays. An empty table gives an empty result. Other columns are not read, and
those of the same names as the results are no hindrance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bucket_of, join_facts, text_of, with_ids, without_ids
from notewright.session import stage

LENGTH_BUCKETS = 1 << 16
PREFIX_CHARS = 128


def _length() -> Column:
    return F.octet_length("__text").cast("long")


def _prefix() -> Column:
    return bucket_of(_length(), F.substring("__text", 1, PREFIX_CHARS))


def _with_mates(rows: DataFrame, bucket: Column) -> DataFrame:
    """The buckets that two rows or more fall into."""
    return rows.groupBy(bucket.alias("__b")).count().filter("count > 1").select("__b")


def _mark(rows: DataFrame, bucket: Column, found: DataFrame, flag: str) -> DataFrame:
    hit = F.broadcast(found.withColumn("__hit", F.lit(True)))
    return rows.withColumn("__b", bucket).join(hit, "__b", "left").withColumn(flag, F.col("__hit").isNotNull()).drop("__b", "__hit")


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__text`` and ``__suspect``: whether length and prefix have a possible partner."""
    texts = docs.select(text_of(text_col).alias("__text"))
    by_length = F.pmod(_length(), F.lit(LENGTH_BUCKETS))
    lengths = stage(_with_mates(texts, by_length), "lengths")
    same_length = texts.withColumn("__b", by_length).join(F.broadcast(lengths), "__b", "left_semi")
    prefixes = stage(_with_mates(same_length, _prefix()), "prefixes")
    marked = _mark(docs.withColumn("__text", text_of(text_col)), by_length, lengths, "__same_length")
    marked = _mark(marked, F.when(F.col("__same_length"), _prefix()), prefixes, "__suspect")
    return marked.drop("__same_length")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, full_hash.

    ``full_hash`` (SHA-256, hex) is null for rows that the prefix already told apart,
    unless ``hash_all``.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    needed = F.lit(True) if hash_all else F.col("__suspect")
    hashed = stage(
        suspects(docs).select("doc_id", "__suspect", F.when(needed, F.sha2("__text", 256)).alias("full_hash")), "hashes"
    )
    alone = hashed.filter("not __suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash"
    )
    rows = stage(hashed.filter("__suspect").groupBy("full_hash", "doc_id").agg(F.count("*").alias("copies")), "rows")
    facts = stage(
        rows.groupBy("full_hash").agg(
            F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("ids")
        ),
        "groups",
    )
    grouped = join_facts(rows, facts, "full_hash", "ids").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "full_hash")).withColumnRenamed(
        "doc_id", id_col
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    The decision is made on hashes, so texts move only where a row's bucket holds a row that goes.
    """
    key = lambda hashed: F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), hashed).alias("__key")
    rows = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    keys = stage(rows.groupBy(key(F.col("full_hash"))).agg(F.count("*").alias("copies"), F.max("kept").alias("keeps")), "copies")
    keyed = docs.withColumn("__key", key(F.sha2(text_of(text_col), 256)))
    left = without_ids(keyed, keys.filter("not keeps or copies > 1"), "__key")
    once = with_ids(keyed, keys.filter("keeps and copies > 1"), "__key").dropDuplicates(["__key"])
    return left.unionByName(once).select(*docs.columns)
