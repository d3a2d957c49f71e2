"""The Arrow UDF for words and their places: one pass over the bytes of a batch, a bounded stretch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text looked at together: bounds what a task holds beside its batch and the words found.
STRETCH = 1 << 20
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _stretch(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, their lengths, their starts in code points, and their letters in lower case; texts begin at ``begins``, the last entry is the end."""
    is_word = _IS_WORD[data]
    cuts = begins[:-1][begins[:-1] < len(data)]
    before, after = np.append(False, is_word[:-1]), np.append(is_word[1:], False)
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    first, last = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after)
    # Code points that begin before each byte; those after the first of a character begin none.
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))
    n = np.diff(np.searchsorted(first, begins))
    starts = points[first] - np.repeat(points[begins[:-1]], n)
    return n, last - first + 1, starts, _LOWER[data[is_word]]


def find_words(texts: pa.Array) -> pa.Array:
    """The words ``[A-Za-z0-9]+`` of each text in lower case, with the code point where each begins; none in a null text."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if len(texts) else np.zeros(0, dtype=np.uint8)
    at, found = 0, [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint8),)]
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STRETCH, side="right")) - 1)
        found.append(_stretch(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]))
        at = to
    n, sizes, starts, letters = (np.concatenate(part) for part in zip(*found))

    def offsets(counts: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(counts)).astype(np.int32)

    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets(sizes)), pa.py_buffer(letters))
    places = pa.StructArray.from_arrays([words, pa.array(starts, pa.int32())], names=["word", "start"])
    return pa.ListArray.from_arrays(pa.array(offsets(n), pa.int32()), places)


PLACES = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType())]))


@F.arrow_udf(PLACES)
def word_places(texts: pa.Array) -> pa.Array:
    return find_words(texts)
