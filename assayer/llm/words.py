"""Hashed words of texts as flat arrays, for the operators that work on whole columns of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that a task remembers before it starts anew.
REMEMBERED = 400_000
#: Characters that are worked on at a time.
CHUNK = 2_000_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; a null text has none."""
    return (text or "").encode("utf-8", "replace").lower().split()


def hashed(texts: Iterable[str | None], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in one array, and the place where each text begins (and the last ends)."""
    flat: list[int] = []
    ends = [0]
    for text in texts:
        flat.extend([known[w] for w in words(text)])
        ends.append(len(flat))
    return np.array(flat, dtype=np.uint64), np.array(ends, dtype=np.int64)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cut a column into ranges of about ``CHUNK`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(texts: pa.Array, many: int | None = None, characters: int = CHUNK) -> Iterator[list[str | None]]:
    """A column in lists of ``many`` texts at most, cut where they have about so many ``characters``."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size, 1):
        total += n
        if total >= characters or i - start == many:
            yield texts.slice(start, i - start).to_pylist()
            start, total = i, 0
    if start < len(texts):
        yield texts.slice(start).to_pylist()
