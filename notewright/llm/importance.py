"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are counts of words and word pairs hashed into ``2 ** bits`` buckets with add-one smoothing. The raw
model counts every document. The target model counts labelled good documents; the labels used are a sample of
at most ``label_bound`` rows, chosen by the hash of the id, so that they can be broadcast. A
document's log weight is the sum over its n-grams of log target - log raw.

Weights become a number of documents by a logistic curve, fitted on the labelled rows
that the target model did not see: k is the sum of all documents' chances to be target text. The
k documents with the largest log weight plus Gumbel noise are kept, which is sampling k without
replacement in proportion to the weights. The noise is a function of doc_id and seed, so a lost
task gives the same sample again.

Null texts are empty texts, which have no n-grams and weight 0. Repeated rows get equal keys and
share their fate; rows that tie with the k-th key are kept. Labels that are null or of
unknown documents are ignored. Without labels of both kinds nothing can be told apart and every document is kept.
An empty table gives an empty result. Other columns are carried by :func:`keep_good` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.bytewords import LOWER, mix, run_hashes, small_slices, split_batch
from notewright.llm.common import kth_largest, text_of, without_ids
from notewright.session import stage

BITS = 16
LABEL_BOUND = 20_000
SCALE = 1_000_000  # keys are compared in millionths
CLIP = 200

# White space and control characters stand between words; letters, digits and all non-ASCII bytes make words; the rest marks.
CLASSES = np.ones(256, dtype=np.uint8)
CLASSES[:33] = 0
CLASSES[[b for b in range(33, 128) if not chr(b).isalnum()]] = 2
_PAIR, _AGAIN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and word pair; a word that follows itself makes one common pair."""
    b = split_batch(texts, CLASSES)
    words = run_hashes(LOWER[b.raw], b.start, b.stop)
    near = b.doc[1:] == b.doc[:-1]
    pairs = np.where(words[1:] == words[:-1], _AGAIN, mix(words[:-1] * _PAIR + words[1:]))[near]
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([b.doc, b.doc[1:][near]]), (np.concatenate([words, pairs]) & mask).astype(np.int64)


def label_sample(labels: DataFrame, bound: int, seed: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most ``bound`` rows (doc_id, label, held): the even half trains, the other calibrates."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound).withColumn(
        "held", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int")
    )


def count_models(docs: DataFrame, bits: int) -> np.ndarray:
    """Table (text, target) -> array [2, 2**bits] of raw and target counts, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in small_slices(batches, "text"):
            doc, bucket = ngrams(batch.column("text").to_pylist(), bits)
            target = batch.column("target").to_numpy(zero_copy_only=False)
            total[0] += np.bincount(bucket, minlength=1 << bits)
            total[1] += np.bincount(bucket[target[doc]], minlength=1 << bits)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "raw", "target"])

    sums = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    out = np.zeros((2, 1 << bits), dtype=np.int64)
    for bucket, raw, target in sums.collect():  # at most 2**bits rows
        out[:, bucket] = raw, target
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    smooth = np.log(counts + 1.0) - np.log(counts.sum(axis=1, keepdims=True) + counts.shape[1])
    return smooth[1] - smooth[0]


def fit_logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through counts of good and bad at ``x``."""
    scale = max(1.0, float(np.abs(x).max()))
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        n = good + bad
        grad = a.T @ (good - n * p) - ridge * w * [1e-3, 1e-3]
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2) * 1e-3
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def resample(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = BITS,
    label_bound: int = LABEL_BOUND,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_grams, log_weight, chance, key, kept), one per row of ``docs``."""
    sample = stage(label_sample(labels, label_bound, seed, id_col), "labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    target = F.broadcast(sample.filter("label = 1 and held = 0").select("doc_id", F.lit(True).alias("target")))
    counts = count_models(texts.join(target, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), bits)
    ratio = log_ratio(counts) if counts[1].any() else np.zeros(1 << bits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            doc, bucket = ngrams(batch.column("text").to_pylist(), bits)
            weight, n = np.bincount(doc, ratio[bucket], minlength=batch.num_rows), np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight)], names=["doc_id", "n_grams", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stage(texts.mapInArrow(score, f"doc_id {kind}, n_grams long, log_weight double"), "weights")
    binned = (
        scored.join(F.broadcast(sample.filter("held = 1")), "doc_id")
        .groupBy(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.round("log_weight"))).cast("int").alias("x"))
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
        .collect()
    )
    x, good, bad = np.array([tuple(r) for r in binned], dtype=float).reshape(-1, 3).T
    known = good.sum() > 0 and bad.sum() > 0 and bool(counts[1].any())
    slope, level = fit_logistic(x, good, bad) if known else (0.0, 35.0)
    clipped = F.greatest(F.lit(float(-CLIP)), F.least(F.lit(float(CLIP)), "log_weight"))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed + 2)), 12) + 0.5) / float(1 << 52)
    keyed = stage(
        scored.withColumn("chance", 1 / (1 + F.exp(-(clipped * slope + level))))
        .withColumn("key", F.round((F.col("log_weight") - F.log(-F.log(uniform))) * SCALE).cast("long")),
        "keys",
    )
    k = keyed.agg(F.sum("chance")).first()[0]
    bar = kth_largest(keyed, "key", round(k)) if k is not None and known else None
    kept = F.col("key") >= bar if bar is not None else F.lit(not known)
    return keyed.withColumn("kept", kept).select(F.col("doc_id").alias(id_col), "n_grams", "log_weight", "chance", (F.col("key") / SCALE).alias("key"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` keeps."""
    id_col = options.get("id_col", "doc_id")
    verdicts = resample(docs, labels, **options)
    return without_ids(docs, stage(verdicts.filter("not kept").select(id_col), "rejected"), id_col)
