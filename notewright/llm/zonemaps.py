"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are turned into integers and sorted along a Hilbert curve through the cells that their components fall into; runs of that order become blocks, each stored
with the smallest and largest value of every component: its box. The blocks are written once and read by every round.

A round first asks the boxes. With c the centroid nearest to the box's middle, the difference of the squared distances to any other centroid d and to c is linear
in the vector, so its smallest value over the box is found component by component. Where that is above zero, no vector of the
block is nearer to d than to c, and d is no candidate. All vectors of a block are then compared with its candidates exactly, in one matrix product.
Equal distances go to the smaller number, which this filter keeps, as it drops a centroid only where it is strictly farther.

Components are floor(scale * x) in double precision. Sums, distances and means are integers and exact: products run in doubles where all partial sums stay below 2**53, else in
64-bit integers; components are held within +-2**24 and so every squared distance within a long. Per task and cluster one row of sums is handed on, so the
driver sees ``k`` centroids and nothing else.

Kept are vectors with exactly ``dim`` components, none null, NaN or infinite; others, and null vectors, give no row. A row with a null id is clustered, but a starting centroid only after
all others. Repeated rows count one by one, and equal rows lie next to each other but in as many blocks and tasks as they need. Fewer vectors than ``k`` give as many
centroids. A cluster that loses all vectors keeps its centroid. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import task_count
from notewright.session import stage

BLOCK = 256
ROWS_PER_TASK = 100_000
LARGEST = 1 << 24


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (row of integers below 2**bits) on the Hilbert curve, as bytes that sort like it.

    The usual transposed form: per bit from the highest, coordinates are reflected or exchanged with the first; then Gray decoding; bits of all coordinates are interleaved.
    """
    x = cells.T.astype(np.int64)
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    return np.packbits(np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that may be nearest to a vector in the box, ascending."""
    middle = (low + high) / 2
    best = centroids[((centroids - middle) ** 2).sum(axis=1).argmin()]
    # |x - d|^2 - |x - best|^2 = |d|^2 - |best|^2 - 2 x (d - best): smallest at the box's corner on the side of d.
    way = centroids - best
    corner = np.where(way > 0, high, low)
    gap = (centroids**2).sum(axis=1) - (best**2).sum() - 2 * (corner * way).sum(axis=1)
    return np.flatnonzero(gap <= 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer vectors the number of the nearest centroid, the smaller on ties, and the squared distance; exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(largest) ** 2 < 1 << 53 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    square = (c**2).sum(axis=1) - 2 * (x @ c.T)
    at = square.argmin(axis=1)
    return at, (square[np.arange(len(x)), at] + (x**2).sum(axis=1)).astype(np.int64)


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v array<int>) of the vectors that are kept."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        .filter((F.size("v") == dim) & F.coalesce(F.forall("v", fine), F.lit(False)))
        .select("id", F.transform("v", held).alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def zone_map(rows: DataFrame, dim: int, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (id, v) -> blocks (ids, vectors, low, high) along the Hilbert curve, written to the shared folder.

    The cells cut every component at its own quantiles, 2**bits parts with about equally many vectors each, so that outliers don't widen them. The
    quantiles are approximate, which moves vectors along the curve and changes no result.
    """
    parts = 1 << bits
    shares = [i / parts for i in range(1, parts)]
    n, *cuts = rows.agg(F.count("*"), *(F.percentile_approx(F.col("v")[i], shares, 1000) for i in range(dim))).first()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                cells = np.stack([np.searchsorted(cuts[i], x[:, i], side="left") for i in range(dim)], axis=1)
                keys = hilbert_keys(cells, bits)
                yield batch.append_column("key", pa.array([k.tobytes() for k in keys], pa.binary()))

    # The stored number spreads equal vectors over ranges, and a lost task finds the same ranges again.
    numbered = rows.mapInArrow(keyed, "id long, v array<int>, key binary").withColumn("nth", F.xxhash64(F.monotonically_increasing_id()))
    numbered = stage(numbered, "hilbert-keys")
    tasks = task_count(rows.sparkSession, n, ROWS_PER_TASK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = _matrix(part.column("v"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([x.astype("<i4").tobytes()], pa.binary()),
                        pa.array([x.min(axis=0)], pa.list_(pa.int32())),
                        pa.array([x.max(axis=0)], pa.list_(pa.int32())),
                    ],
                    names=["ids", "vectors", "low", "high"],
                )

    ordered = numbered.repartitionByRange(tasks, "key", "nth").sortWithinPartitions("key", "nth").select("id", "v")
    return stage(ordered.mapInArrow(blocks, "ids array<long>, vectors binary, low array<int>, high array<int>"), "hilbert-blocks")


def _placed(batch: pa.RecordBatch, dim: int, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per block its ids, vectors, nearest centroids, squared distances, and how many candidates it had."""
    low, high = _matrix(batch.column("low")), _matrix(batch.column("high"))
    for k, packed in enumerate(batch.column("vectors")):
        x = np.frombuffer(packed.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
        some = candidates(low[k], high[k], centroids)
        at, distance = nearest(x, centroids[some])
        yield batch.column("ids")[k].values, x, some[at], distance, len(some)


def assign(blocks: DataFrame, dim: int, centroids: np.ndarray) -> DataFrame:
    """Rows (id, cluster, distance, n_candidates): every vector's nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, at, distance, n in _placed(batch, dim, centroids):
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(at, pa.int32()), pa.array(distance), pa.array(np.full(len(at), n), pa.int32())], names=["id", "cluster", "distance", "n_candidates"]
                )

    return blocks.mapInArrow(run, "id long, cluster int, distance long, n_candidates int")


def move(blocks: DataFrame, dim: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for batch in batches:
            for _, x, at, _, _ in _placed(batch, dim, centroids):
                count += np.bincount(at, minlength=len(count))
                # One product per block: rows of its vectors added up by cluster.
                found, slot = np.unique(at, return_inverse=True)
                total[found] += (slot == np.arange(len(found))[:, None]).astype(np.int64) @ x
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(count[got]), pa.array(list(total[got]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    sums = blocks.mapInArrow(run, "cluster int, n long, total array<long>")
    whole = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"))
    moved = centroids.copy()
    for r in whole.collect():  # at most one row per centroid
        moved[r["cluster"]] = [t // r["n"] for t in r["total"]]
    return moved


def first_centroids(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of "seed:id"; equal ids go by their vectors, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64).reshape(-1, dim)


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_candidates), one per kept vector.

    ``n_candidates``: the centroids that the boxes left for the vector's block in the last assignment.
    """
    rows = stage(quantised(vectors, dim, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(rows, k, seed, dim)
    blocks = zone_map(rows, dim)
    for _ in range(rounds):
        centroids = move(blocks, dim, centroids)
    found = stage(assign(blocks, dim, centroids), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    table = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_candidates"
    )
