"""Token ids by the ``tokenizers`` library, with a bounded memory for words seen before."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import regex
from tokenizers import Tokenizer

REMEMBERED = 400_000  # words in each half of a worker's memory; both together take about 150 MB
# White space as the byte-level pattern knows it; a text may be cut before any run of it.
_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# First a plain word: letters of Latin-1 that no letter or mark can follow, which the pattern below never splits or extends.
# Otherwise white space and what follows it up to the next.
_CHUNK = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\xff]|[ªµº])|[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Memory(dict):
    """Key -> what ``make`` gives for it. Full, it becomes the older half, from which keys still in use come back."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives ids like ``Tokenizer.encode(text, add_special_tokens=False)``.

    As in the library, the names of added tokens within a text are those tokens; such texts are left to it. For a byte-level model
    the library's own splitting is most of the cost, so texts are split here by the same pattern and
    the library's model is asked once per distinct word; any other tokenizer file is
    used as it is.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        config = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in config.get("added_tokens") or []]
        pre = config.get("pre_tokenizer") or {}
        self.by_words = (
            config["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and config.get("normalizer") is None
        )
        model, letters, width = self.tokenizer.model, _byte_letters(), self.dtype.itemsize

        def of_word(word: str) -> bytes:
            mapped = word.encode("utf-8", "replace").decode("latin-1").translate(letters)
            return b"".join([t.id.to_bytes(width, "little") for t in model.tokenize(mapped)])

        self.chunks = Memory(lambda chunk: b"".join([of_word(w) for w in _WORDS.findall(chunk)]), remembered)

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words or any(name in text for name in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        seen = self.chunks
        return np.frombuffer(b"".join([seen[c] for c in _CHUNK.findall(text)]), dtype=self.dtype)

    def encode_all(self, texts: Iterable[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text, null texts as empty ones, with ``end`` appended if given."""
        tail = np.array([] if end is None else [end], dtype=self.dtype)
        with no_collection():
            for text in texts:
                yield np.concatenate([self.encode(text or ""), tail])


@contextmanager
def no_collection():
    """Millions of short-lived small objects, none in cycles: the collector only costs time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker, file and size of its memory."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]
