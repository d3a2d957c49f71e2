"""Words of a batch of texts as numpy arrays: where they begin and end, and a hash of each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of codes[start:stop] for each run, equal wherever the run stands."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(codes)), out=sums[1:])
    back = powers(pow(_ODD, -1, 1 << 64), len(codes) + 1)
    return mix((sums[stop] - sums[start]) * back[start])


@dataclass
class Batch:
    """Texts side by side, a line feed after each; ``doc`` is the text each word is in."""

    raw: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray


def split_batch(texts: list[str], classes: np.ndarray) -> Batch:
    """Words are runs of bytes of one class; class 0 stands between them."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    edges = np.cumsum([len(p) + 1 for p in parts])
    kind = classes[raw]
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    start = change[kind[np.minimum(change, len(kind) - 1)] > 0] if len(kind) else change
    start = start[start < len(kind)]
    stop = change[np.searchsorted(change, start) + 1]
    return Batch(raw, edges, start, stop, np.searchsorted(edges, start, side="right"))


def small_batches(texts: list[str], limit: int = 1 << 20):
    """Slices of ``texts`` with about ``limit`` characters; one text alone may have more."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def small_slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, so that what is made of a slice stays small; one text alone may have more."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
