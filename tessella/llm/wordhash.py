"""Rolling hashes over words, vectorised, for code that runs on executors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the two rolling hashes (mod 2**64) and of the finaliser; any odd numbers would do.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Text worked on at once, in bytes.
CHUNK = 1 << 20


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[list[bytes]]) -> np.ndarray:
        n = sum(map(len, words))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for these sizes much faster than numpy's hashing unique()."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values, from prefix sums over inverse powers."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * np.cumprod(inverse), out=sums[1:])
    power = np.full(n - width + 1, base, np.uint64)
    power[0] = 1
    return mix((sums[width:] - sums[:-width]) * np.cumprod(power))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def text_chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def spans(words: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of a chunk, and which of its windows of ``width`` words lie in one row."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), counts)
    ends = np.cumsum(counts)[row] if len(row) else row
    inside = np.arange(len(row)) + width <= ends
    return row, inside[: max(0, len(row) - width + 1)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
