"""SimHash near duplicates: exact tiled comparison by exclusive-or and bit counts.

A fingerprint has one or more 64-bit words; every distinct one is compared once, however many rows have it.
Fingerprints are dealt to tiles by population counts (for a small radius those of four 16-bit parts, else the count of
all bits in steps of the radius), and by size class where sizes must be alike. Within ``radius`` bits the counts
differ by ``radius`` in sum at most, so all other pairs of tiles are skipped, which loses no link. Tiles are cut into blocks
of about ``BLOCK``, and a pair of blocks is one row: numpy takes the exclusive-or of all pairs in it, counts bits, and hands on
at most one link per fingerprint, enough to keep everything connected that is.

:func:`near_groups` links by fingerprints alone. :func:`drop_near` uses them only to search: fingerprints of sets of distinct
shingles are compared within a radius that leaves slack, and of the groups found so all pairs within the radius are
checked by the exact Jaccard similarity of their sets before links are closed. At the least similarity of 0.8 a
pair is missed with a chance of 0.00005 where four shingles stand against five, and under one in a million for larger sets (exact binomials). Sets are of 64-bit hashes.

Null texts are empty texts; a text without words has fingerprint zero and is linked like
any other. Equal texts share a fingerprint and so a group. Rows with a null doc_id take part;
their group is named by the smallest id that is not null. Repeated rows come back as often. An empty
table gives an empty result. Other columns are carried by :func:`drop_near` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import acos, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.bytewords import mix
from notewright.llm.common import join_facts, text_of, with_bucket, without_ids
from notewright.llm.components import connected_components, star_links
from notewright.session import stage

SEED = 42
BLOCK = 2048
ROWS_AT_ONCE = 256
FIELD = 64  # room for each count in a tile's key: counts stay under 32, so no step runs into another count
CHUNK = 1 << 14
TEXTS, TEXT_BYTES = 512, 4 << 20  # in a block of texts whose sets are compared
_NEXT = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle; a shorter text is one shingle."""
    found = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(found) - shingle + 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray, words: int) -> bytes:
    """Big-endian words of the bits set in over half the hashes; further words take the hashes mixed anew."""
    votes = np.zeros((words, 64), dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        for k in range(words):
            bits = np.unpackbits((mix(part + np.uint64(_NEXT * k % (1 << 64))) if k else part).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), axis=1, bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprint(text: str, shingle: int, words: int = 1) -> tuple[bytes, int]:
    """Big-endian words of the bits set in over half the hashes of all word shingles, and how many shingles."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes, words), len(hashes)


def set_fingerprint(text: str, shingle: int, words: int) -> tuple[bytes, int, bytes]:
    """The same over the distinct shingles, how many these are, and a digest that equal sets share."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return majority(hashes, words), len(hashes), xxhash.xxh3_128_digest(hashes.tobytes())


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp BINARY, size), size the number of shingles."""

    @F.pandas_udf("fp binary, size long")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fingerprint(t, shingle, words) for t in texts], columns=["fp", "size"])

    return docs.select(F.col(id_col).alias("doc_id"), of(text_of(text_col)).alias("x")).select("doc_id", "x.fp", "x.size")


def _tiles(radius: int, words: int, min_ratio: float | None) -> tuple[Column, list[int]]:
    """A tile's key, and the steps from it to the tiles that may hold a link; each pair of tiles once."""
    word = lambda k: F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long")
    if radius < 4:
        part = lambda k, i: F.bit_count(F.shiftrightunsigned(word(k), 16 * i).bitwiseAND(0xFFFF))
        counts = [part(k, i) for k in range(words) for i in range(4)]
        near = [d for d in product(range(-radius, radius + 1), repeat=len(counts)) if sum(map(abs, d)) <= radius]
    else:
        counts = [F.floor(sum((F.bit_count(word(k)) for k in range(words)), F.lit(0)) / radius)]
        near = [(-1,), (0,), (1,)]
    if min_ratio is not None:
        counts.append(F.floor(F.log(F.greatest("size", F.lit(1))) / -log(min_ratio)))
        near = [(*d, s) for d in near for s in (-1, 0, 1)]
    key = sum((c * FIELD**i for i, c in enumerate(counts)), F.lit(0)).cast("long")
    return key, sorted(k for k in (sum(x * FIELD**i for i, x in enumerate(d)) for d in near) if k >= 0)


def fingerprint_links(fps: DataFrame, radius: int, words: int = 1, min_ratio: float | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct (fp, size, node) -> links (a, b) of nodes that connect what the true links connect."""
    key, steps = _tiles(radius, words, min_ratio)
    tiled = fps.select(F.struct("node", "fp", "size").alias("item"), key.alias("tile"))
    counts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).alias("n_blocks"))
    blocks = stage(
        tiled.join(F.broadcast(counts), "tile")  # at most 17 ** 4 tiles of part counts, or FIELD ** 2 of counts and size classes
        .withColumn("block", F.pmod(F.xxhash64("item.fp"), "n_blocks"))
        .groupBy("tile", "block")
        .agg(F.collect_list("item").alias("items")),
        "tiles",
    )
    left = blocks.select(
        F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("items").alias("a"),
        F.explode(F.array(*(F.lit(k).cast("long") for k in steps))).alias("step"),
    ).withColumn("tile", F.col("tile_a") + F.col("step"))
    pairs = left.join(blocks.withColumnRenamed("items", "b"), "tile").filter("step > 0 or block_a <= block").select("a", "b")

    def unpack(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(items.field("fp").to_pylist()), dtype=">u8").reshape(-1, words).astype(np.uint64)
        return items.field("node").to_numpy(), raw, np.maximum(items.field("size").to_numpy(), 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                (node_a, x, size_a), (node_b, y, size_b) = unpack(a.values), unpack(b.values)
                left, right = [], []
                for at in range(0, len(x), ROWS_AT_ONCE):
                    part = x[at : at + ROWS_AT_ONCE]
                    apart = np.bitwise_count(part[:, None, 0] ^ y[None, :, 0]).astype(np.uint16)
                    for k in range(1, words):
                        apart += np.bitwise_count(part[:, None, k] ^ y[None, :, k])
                    i, j = np.nonzero(apart <= radius)
                    if min_ratio is not None:
                        s, t = size_a[at + i], size_b[j]
                        i, j = (v[np.minimum(s, t) >= min_ratio * np.maximum(s, t)] for v in (i, j))
                    left.append(i + at)
                    right.append(j + len(x))
                label = star_links(len(x) + len(y), np.concatenate(left), np.concatenate(right))
                both = np.concatenate([node_a, node_b])
                linked = (label != np.arange(len(both))) & (both != both[label])
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(both[linked]), pa.array(both[label[linked]])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame, shingle: int = 3, radius: int = 2, words: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id that links of fingerprints reach."""
    rows = stage(fingerprints(docs, shingle, words, id_col, text_col), "fingerprints")
    fps = stage(
        rows.groupBy("fp")
        .agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first"), F.first("size").alias("size"))
        .withColumn("node", F.monotonically_increasing_id()),
        "distinct-fps",
    )
    roots = connected_components(fingerprint_links(fps, radius, words))
    rooted = fps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = stage(rooted.join(ids, "root").select("fp", "n_rows", "component_id"), "fp-groups")
    return join_facts(rows, facts, "fp", "n_rows").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def candidate_radius(similarity: float, words: int) -> int:
    """Bits in which large sets of that Jaccard similarity are expected to differ, and six standard deviations."""
    bits, apart = 64 * words, acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * apart + 6 * sqrt(bits * apart * (1 - apart)))


def jaccard_links(
    texts: DataFrame, shingle: int, similarity: float, radius: int, words: int, block: int = TEXTS, block_bytes: int = TEXT_BYTES
) -> DataFrame:
    """(node, root, fp, size, n_bytes, text), one row a node -> links (a, b) of nodes of like sets that connect what all such links of a root connect.

    A root's texts are cut into blocks, and pairs of blocks are compared, which is quadratic in a group of many blocks.
    """
    most = F.greatest(F.count("*") / block, F.sum("n_bytes") / block_bytes)
    counts = texts.groupBy("root").agg(F.ceil(most).cast("long").alias("n_blocks"))
    heavy = stage(counts.filter("n_blocks > 1"), "large-groups")  # few, each has over a block of texts
    cut = texts.join(heavy, "root", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long")))
    blocks = stage(
        cut.withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks"))
        .groupBy("root", "block", "n_blocks")
        .agg(F.collect_list(F.struct("node", "fp", "size", "text")).alias("items")),
        "text-blocks",
    )
    single = blocks.filter("n_blocks = 1").select(F.col("items").alias("a"), F.lit(None).cast(blocks.schema["items"].dataType).alias("b"))
    several = blocks.filter("n_blocks > 1")
    left = several.select("root", F.col("items").alias("a"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("block"))
    right = several.select("root", "block", F.col("items").alias("b"))
    crossed = left.join(right, ["root", "block"]).select("a", F.when(F.col("i") < F.col("block"), F.col("b")).alias("b"))

    def unpack(items: pa.StructArray):
        raw = np.frombuffer(b"".join(items.field("fp").to_pylist()), dtype=">u8").reshape(-1, words).astype(np.uint64)
        sets = [np.unique(shingle_hashes(t, shingle)) for t in items.field("text").to_pylist()]
        return items.field("node").to_numpy(), raw, sets

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                one = unpack(a.values)
                two = unpack(b.values) if b.is_valid else one
                left, right = like_sets(one[1], one[2], two[1], two[2], similarity, radius)
                both = np.concatenate([one[0], two[0]]) if b.is_valid else one[0]
                label = star_links(len(both), left, right + (len(one[0]) if b.is_valid else 0))
                linked = label != np.arange(len(both))
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(both[linked]), pa.array(both[label[linked]])], names=["a", "b"])

    return single.unionByName(crossed).mapInArrow(verify, "a long, b long")


def like_sets(
    x: np.ndarray, xs: list[np.ndarray], y: np.ndarray, ys: list[np.ndarray], similarity: float, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs whose fingerprints lie within the radius and whose sets have that Jaccard similarity."""
    sizes = np.array([len(s) for s in ys], dtype=np.int64)
    known, flat = np.unique(np.concatenate([*ys, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(known) + 1, dtype=np.int64)
    left, right = [], []
    for i, mine in enumerate(xs):
        near = np.bitwise_count(x[i] ^ y).sum(axis=1, dtype=np.int64) <= radius
        j = np.flatnonzero(near & (np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine)) - 1e-9))
        if not len(j) or not len(known):
            continue
        at = np.searchsorted(known, mine)
        at = at[known[np.minimum(at, len(known) - 1)] == mine]
        marked[at] = 1
        shared = np.array([marked[flat[ends[k] - sizes[k] : ends[k]]].sum() for k in j], dtype=np.int64)
        marked[at] = 0
        j = j[shared >= similarity * (len(mine) + sizes[j] - shared) - 1e-9]
        left.append(np.full(len(j), i))
        right.append(j)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, component_id): the smallest doc_id that links of texts whose shingle sets have that Jaccard similarity reach."""

    @F.pandas_udf("fp binary, size long, same binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([set_fingerprint(t, shingle, words) for t in texts], columns=["fp", "size", "same"])

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    rows = stage(
        texts.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), of("text").alias("x")).select("doc_id", "text_hash", "n_bytes", "x.*"),
        "set-fingerprints",
    )
    sets = stage(
        rows.groupBy("same")
        .agg(
            F.count("*").alias("n_rows"), F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"),
            F.min(F.struct("n_bytes", "text_hash")).alias("text"),
        )
        .select("same", "n_rows", "first", "fp", "size", "text.*")
        .withColumn("node", F.monotonically_increasing_id()),
        "distinct-sets",
    )
    radius = candidate_radius(similarity, words)
    # Unlike sets below that size cannot reach the similarity: one shingle more or less is already too much.
    large = sets.filter((F.col("size") + 1) * similarity <= F.col("size") + 1e-9).select("fp", "size", "node")
    found = connected_components(fingerprint_links(large, radius, words, similarity))
    wanted = stage(sets.select("node", "fp", "size", "n_bytes", "text_hash").join(found, "node"), "candidates")
    known = with_bucket(texts, wanted, "text_hash").groupBy("text_hash").agg(F.first("text").alias("text"))
    roots = connected_components(jaccard_links(wanted.join(known, "text_hash"), shingle, similarity, radius, words))
    rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = stage(rooted.join(ids, "root").select("same", "n_rows", "component_id"), "set-groups")
    return join_facts(rows, facts, "same", "n_rows").select(F.col("doc_id").alias(id_col), "component_id")


def drop_near(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the row of the smallest id of each of :func:`similar_groups`; rows with a null id stay.

    Four words keep unlike texts from meeting by chance: with 64 bits the search would bring up clean documents of a large table.
    """
    groups = similar_groups(docs, shingle, similarity, words, id_col, text_col)
    return without_ids(docs, stage(groups.filter(F.col(id_col) != F.col("component_id")).select(id_col), "near-dropped"), id_col)
