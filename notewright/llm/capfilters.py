"""Near duplicate vectors by spherical-cap filters.

Vectors are turned by a random rotation and cut into four parts, each with a code of random unit directions. A
filter is one direction per part, so ``codewords ** 4`` filters need only ``4 * codewords`` inner products; a vector passes
the filters whose cap it lies in, that is whose summed inner product reaches a threshold. List decoding finds all of these: sums over two
parts each are made first, and only those that can reach the threshold with the best of the other half are joined. A vector with few
filters gets its ``least`` best ones, so none is left alone. The number of filters follows the
number of vectors, so buckets stay as full at any size.

Vectors meet in equal filters of equal labels. Every pair that meets is verified by its cosine in double precision, so no link is
false; a link is missed only where two vectors share no filter, and close ones share most. A pair is counted in the smallest
filter it shares. Equal vectors are one representative with a count. Large buckets are cut into blocks, and pairs of blocks
hand on counts and at most one link per vector, so no set of pairs is ever written out.

A vector that is null, empty or zero or has null or non-finite components, or whose label is null, links
with nothing and is its own component, as is every row with a null id. Vectors of different lengths never link. Repeated rows
count like different rows: each is one more link of the other, and they share a component. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import join_facts
from notewright.llm.components import connected_components, star_links
from notewright.session import stage

PARTS = 4
BLOCK = 512
EXPECTED, LEAST = 12, 12


@lru_cache(maxsize=8)
def product_code(dim: int, codewords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation [dim, padded dim], and unit directions [parts, codewords, padded dim / parts]."""
    rnd = np.random.default_rng([seed, dim, codewords])
    width = -(-dim // PARTS)
    turn = np.linalg.qr(rnd.standard_normal((width * PARTS, width * PARTS)))[0][:dim]
    code = rnd.standard_normal((PARTS, codewords, width))
    return turn, code / np.linalg.norm(code, axis=2, keepdims=True)


def decode_filters(unit: np.ndarray, codewords: int, expected: int, least: int, seed: int) -> list[np.ndarray]:
    """The sorted numbers of each unit vector's filters."""
    dim = unit.shape[1]
    turn, code = product_code(dim, codewords, seed)
    parts = (unit @ turn).reshape(len(unit), PARTS, -1)
    dots = np.einsum("npw,pcw->npc", parts, code)
    sums = [(dots[:, k, :, None] + dots[:, k + 1, None, :]).reshape(len(unit), -1) for k in (0, 2)]
    n_filters = codewords**PARTS
    share = min(0.5, expected / n_filters)
    bar = NormalDist(0, (PARTS / (parts.shape[2] * PARTS)) ** 0.5).inv_cdf(1 - share)
    few = min(least, sums[0].shape[1])
    out = []
    for a, b in zip(*sums):
        # The `few` best totals use only the `few` best of either half.
        top = [np.partition(h, -few)[-few:] for h in (a, b)]
        best = np.partition((top[0][:, None] + top[1][None, :]).ravel(), -few)[-few]
        low = min(bar, best)
        i, j = np.flatnonzero(a >= low - b.max()), np.flatnonzero(b >= low - a.max())
        x, y = np.nonzero(a[i, None] + b[None, j] >= low)
        out.append(np.sort(i[x] * len(b) + j[y]))
    return out


def usable(df: DataFrame, label: str, vector: str, name: str):
    """Whether a row can link with others."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return (
        F.col(name).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    expected: int = EXPECTED,
    least: int = LEAST,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fits = usable(rows, "label", "v", "id")
    alone = rows.filter(~fits).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = stage(rows.filter(fits).withColumn("v", F.transform("v", lambda x: x.cast("double") + 0.0)).withColumn("same", F.struct("label", "v")), "vectors")
    unique = stage(
        rows.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")).withColumn("node", F.monotonically_increasing_id()), "unique-vectors"
    )
    points = unique.select("node", F.col("same.label").alias("label"), F.col("same.v").alias("v"), "n_rows")
    filters = stage(_filters(points, expected, least, seed), "filters")
    found = stage(_verified(points, filters, threshold), "verified")
    degrees = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = unique.join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = stage(
        rooted.join(names, "root").select("same", "n_rows", (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "component_id"), "vector-groups"
    )
    linked = join_facts(rows, facts, "same", "n_rows").select("id", "n_links", "component_id")
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _filters(points: DataFrame, expected: int, least: int, seed: int) -> DataFrame:
    """Rows (node, label, dim, filters), for vectors that share a label and a length with others."""
    codewords = int(np.clip(round(points.count() ** (1 / PARTS)), 4, 256))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, node = batch.column("v"), batch.column("node").to_numpy()
            flat, dims = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            at = np.cumsum(dims) - dims
            for dim in np.unique(dims):
                which = np.flatnonzero(dims == dim)
                for k in range(0, len(which), 256):
                    part = which[k : k + 256]
                    x = flat[at[part][:, None] + np.arange(dim)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    hit = decode_filters(x / np.linalg.norm(x, axis=1, keepdims=True), codewords, expected, least, seed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[part]), pa.array(np.full(len(part), dim), pa.int64()), pa.array(hit, pa.list_(pa.int64()))], names=["node", "dim", "filters"]
                    )

    coded = points.select("node", "v").mapInArrow(decode, "node long, dim long, filters array<long>")
    return coded.join(points.select("node", "label"), "node")


def _verified(points: DataFrame, filters: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, n) with counts of links, and rows (node, other) that connect what links connect."""
    key = ["label", "dim", "filter"]
    members = filters.select("label", "dim", F.explode("filters").alias("filter"), "node", "filters")
    # Only filters that two vectors or more pass are of use; their vectors are fetched once they are known.
    counts = members.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("n_blocks", F.ceil(F.col("n") / BLOCK))
    blocks = stage(
        members.join(counts, key)
        .join(points.select("node", "v", "n_rows"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks"))
        .groupBy(*key, "block", "n_blocks")
        .agg(F.collect_list(F.struct("node", "v", "n_rows", "filters")).alias("items")),
        "vector-blocks",
    )
    single = blocks.filter("n_blocks = 1").select("filter", F.col("items").alias("a"), F.lit(None).cast(blocks.schema["items"].dataType).alias("b"))
    several = blocks.filter("n_blocks > 1").drop("n_blocks")
    left, right = several.select(*key, F.col("block").alias("i"), F.col("items").alias("a")), several.select(*key, F.col("block").alias("j"), F.col("items").alias("b"))
    crossed = left.join(right, key).filter("i <= j").select("filter", "a", F.when(F.col("i") < F.col("j"), F.col("b")).alias("b"))

    def unpack(items):
        raw = items.values
        v = raw.field("v")
        x = v.flatten().to_numpy().reshape(len(raw), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        lists = raw.field("filters")
        owner = np.repeat(np.arange(len(raw)), np.diff(lists.offsets.to_numpy()))
        return raw.field("node").to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True), raw.field("n_rows").to_numpy(), owner, lists.flatten().to_numpy()

    def earlier(one, two, number: int) -> np.ndarray:
        """Which pairs share a filter before ``number``, where they are counted."""
        known = np.unique(np.concatenate([one[4][one[4] < number], two[4][two[4] < number]]))
        sides = []
        for _, x, _, owner, passed in (one, two):
            grid = np.zeros((len(x), len(known)), dtype=np.float32)
            keep = passed < number
            grid[owner[keep], np.searchsorted(known, passed[keep])] = 1
            sides.append(grid)
        return sides[0] @ sides[1].T > 0

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, others, counts = [], [], []
            for number, a, b in zip(batch.column("filter").to_pylist(), batch.column("a"), batch.column("b")):
                one = unpack(a)
                two = unpack(b) if b.is_valid else one
                near = one[1] @ two[1].T >= threshold
                if not b.is_valid:
                    near &= np.tri(len(near), k=-1, dtype=bool).T
                if not near.any():
                    continue
                fresh = near & ~earlier(one, two, number)
                for mine, n in ((one[0], fresh @ two[2]), (two[0], fresh.T @ one[2])):
                    nodes.append(mine[n > 0])
                    counts.append(n[n > 0])
                    others.append(np.full((n > 0).sum(), -1))
                i, j = np.nonzero(near)
                both = np.concatenate([one[0], two[0]]) if b.is_valid else one[0]
                label = star_links(len(both), i, j + (len(one[0]) if b.is_valid else 0))
                linked = label != np.arange(len(both))
                nodes.append(both[linked])
                others.append(both[label[linked]])
                counts.append(np.zeros(linked.sum(), dtype=np.int64))
            if nodes:
                other = np.concatenate(others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(other, mask=other < 0), pa.array(np.concatenate(counts))], names=["node", "other", "n"]
                )

    return single.unionByName(crossed).mapInArrow(verify, "node long, other long, n long")
