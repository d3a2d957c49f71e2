"""Packing documents into windows: non-negative least squares over length combinations.

Every document's ids, the end id included, are cut into full windows and a remainder. The counts of
the lengths are a histogram with at most ``window`` entries. For it, ways to fill a window exactly
with one, two or three lengths are enumerated (of three, those whose smallest length lies on a grid), and how often
to repeat each is the non-negative least squares solution against the histogram. The rounded repeats use
up most pieces; what is left of the histogram is packed greedily, largest length first, many equal windows at
once. Only then do pieces meet their places: the pieces of each length are numbered, and the number says
which window and offset a piece gets. Work on the driver depends on the window alone.

Null texts are empty texts and hold the end id. Rows with a null doc_id and repeated rows are packed like all
others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.encoder import REMEMBERED, encoder
from notewright.session import stage

GRID = 16
ROUNDS = 400
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, rank long"


def pieces(docs: DataFrame, vocabulary: str, window: int, end: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Rows per piece; ``rank`` numbers the pieces of a length within ``task``. Not repeatable: stage it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary, remembered), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all((t.as_py() for t in batch.column("text")), end)):
                wide = ids.astype("<u4")
                for a in range(0, len(ids), window):
                    n = min(window, len(ids) - a)
                    out.append((name, a, n, zlib.crc32(wide[a : a + n]), len(ids), task, int(seen[n])))
                    seen[n] += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES)


def combinations(window: int, lengths: np.ndarray, grid: int = GRID) -> np.ndarray:
    """Rows of three lengths that fill the window, largest first and 0 where there are fewer."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    there[0] = True
    rows = []
    for c in range(0, window // 3 + 1):
        if there[c] and c % grid == 0:
            b = np.arange(c, (window - c) // 2 + 1)
            a = window - c - b
            ok = there[a] & there[b] & (a > 0)
            rows.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], axis=1))
    return np.concatenate(rows)


def solve_repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of repeats against counts, by multiplicative updates."""
    size = len(counts)
    spread = lambda x: sum(np.bincount(c, x, minlength=size) for c in combos.T)
    gather = lambda h: sum(h[c] for c in combos.T)
    target = counts.astype(float)
    target[0] = 0
    goal = gather(target)
    x = goal / max(len(combos), 1)
    for _ in range(rounds):
        fit = spread(x)
        fit[0] = 0
        x *= goal / np.maximum(gather(fit), 1e-12)
    return x


def greedy_patterns(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Largest length first, then the largest that still fits; each pattern as often as counts allow."""
    out = []
    while (there := np.flatnonzero(left)).size:
        rest, pattern, used = window, [], {}
        while there.size:
            there = there[: np.searchsorted(there, rest, side="right")]
            if not there.size:
                break
            n = int(there[-1])
            take = min(rest // n, int(left[n]))
            pattern += [n] * take
            used[n] = take
            rest -= n * take
            there = there[:-1]
        repeats = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * repeats
        out.append((pattern, repeats))
    return out


def plan(histogram: dict[int, int], window: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, repeats) that use every piece of the histogram exactly once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for n, k in histogram.items():
        left[n] = k
    combos = combinations(window, np.flatnonzero(left))
    out = []
    if len(combos):
        wanted = np.rint(solve_repeats(combos, left)).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable"):
            pattern = [int(n) for n in combos[i] if n]
            times = min([int(wanted[i]), *(int(left[n]) // pattern.count(n) for n in pattern)])
            if times > 0:
                for n in pattern:
                    left[n] -= times
                out.append((pattern, times))
    return out + greedy_patterns(left, window)


def places(patterns: list[tuple[list[int], int]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per length and run of ranks: (length, first rank), first window, offset; sorted."""
    used, rows, sequence = np.zeros(window + 1, dtype=np.int64), [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, int(used[n]), sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece. A worker remembers the ids of about twice ``remembered`` words."""
    cut = stage(pieces(docs, vocabulary, window, end, id_col, text_col, remembered), "pieces")
    counts = cut.groupBy("task", "length").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    lengths, ranks, sequences, offsets = places(plan(histogram, window), window)
    # One sorted key from length and rank: ranks stay below 2**48.
    keys = (lengths << 48) + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "start")] + [pa.array(length)] + [batch.column(c) for c in ("ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    numbered = cut.join(counts.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return numbered.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
