"""Token ids in binary files, with the document boundaries in Elias-Fano form.

A file set is a Parquet table of segments in ascending doc_id order, so any store that Spark writes to
will do. A segment holds about ``SEGMENT_TOKENS`` ids of whole documents:

=============  ================================================================================
task, segment  the order of segments
start          ids before it within its task
n_tokens       ids in it
n_null, first  documents without an id, which come first; the smallest id
ids            the ids, little-endian, 2 bytes each for vocabularies up to 65,536, else 4
bounds         Elias-Fano: where each document begins, and the end of the last one
doc_ids        Elias-Fano: the ids of the documents less ``first``
=============  ================================================================================

Null texts are empty texts and hold the end id alone. Documents with equal ids keep the order of their
texts. An empty table gives files without segments. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.common import task_count, text_of
from notewright.llm.encoder import encoder
from notewright.session import shared_folder

SEGMENT_TOKENS = 1 << 20
ROWS_PER_TASK = 50_000
SAMPLE = 256  # every so many values, the place of its bit is kept

_SCHEMA = (
    "task int, segment int, start long, n_tokens long, n_null int, first long, ids binary, bounds binary, doc_ids binary"
)


class EliasFano:
    """Non-decreasing integers >= 0 in about 2 + log2(largest / count) bits each.

    The low bits of each value stand side by side; the high parts are a bit vector with a one per value
    and a zero per step. ``select(i)`` finds the i-th one from the nearest sampled one.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), dtype=np.uint8)
        for b in range(bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, n_low, n_high = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, bits, low, high, np.frombuffer(raw, "<u4", -1, at + n_low + n_high))

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return word >> (a % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, reading a few bytes near the sampled bit before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = bit // 8
        word = int(self.high[byte]) >> (bit % 8) << (bit % 8)
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        out = (at - np.arange(self.n)) << self.low_bits
        for b in range(self.low_bits):
            out |= low[:, b].astype(np.int64) << b
        return out


class Segment:
    """One segment's documents; ``document(i)`` reads two offsets and the ids between them."""

    def __init__(self, row: dict, width: int):
        self.bounds, self.start = EliasFano.from_bytes(row["bounds"]), row["start"]
        self.ids = np.frombuffer(row["ids"], dtype=f"<u{width}")
        self.n_null, self.first, self.doc_ids = row["n_null"], row["first"], EliasFano.from_bytes(row["doc_ids"])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def names(self) -> list[int | None]:
        return [None] * self.n_null + (self.doc_ids.values() + self.first).tolist()


def _segment(task: int, number: int, start: int, names: list, parts: list[np.ndarray]) -> dict:
    known = np.array([x for x in names if x is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return {
        "task": task, "segment": number, "start": start, "n_tokens": int(bounds[-1]), "n_null": len(names) - len(known),
        "first": first, "ids": np.concatenate(parts).tobytes(), "bounds": EliasFano.encode(bounds).to_bytes(),
        "doc_ids": EliasFano.encode((known - first).view(np.uint64)).to_bytes(),
    }


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str | None = None, end: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode every text, append ``end``, and write the segments; returns the path."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        schema = pa.schema([("task", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_null", pa.int32()),
                            ("first", pa.int64()), ("ids", pa.binary()), ("bounds", pa.binary()), ("doc_ids", pa.binary())])
        names, parts, size, number, start = [], [], 0, 0, 0
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            for name, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts, end)):
                names.append(name)
                parts.append(ids)
                size += len(ids)
                if size >= SEGMENT_TOKENS:
                    yield pa.RecordBatch.from_pylist([_segment(task, number, start, names, parts)], schema)
                    names, parts, size, number, start = [], [], 0, number + 1, start + size
        if names:
            yield pa.RecordBatch.from_pylist([_segment(task, number, start, names, parts)], schema)

    tasks = task_count(spark, rows.select("doc_id").count(), ROWS_PER_TASK)
    ordered = rows.repartitionByRange(tasks, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(encode, _SCHEMA).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments in ``path`` with ``start`` counted over all files."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task.
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("own")).select("task", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    return files.join(F.broadcast(tasks), "task").withColumn("start", F.col("start") + F.col("before")).drop("before")


def document_index(segments: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files' own boundaries and ids."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, width)
                bounds, ids = segment.bounds.values(), segment.ids.astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.names(), pa.int64()), pa.array(bounds[:-1] + segment.start), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(index, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_width(vocabulary: str) -> int:
    return encoder(vocabulary).dtype.itemsize
