"""Vectorised text kernels over Arrow string columns (numpy on the UTF-8 bytes, no per-word Python)."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space; all other bytes are parts of words.
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For looser words: all ASCII characters but letters and digits part words.
LOOSE = np.zeros(256, bool)
LOOSE[:128] = [not chr(i).isalnum() for i in range(128)]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser with two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _POWERS[int(base)] = have
    return have[:n]


def tidy() -> None:
    """Gives memory that the end of a partition has freed back to the system: a worker stays for the next task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and its n + 1 offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows into pieces of about `most_bytes` of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of a piece of texts: begin and end (bytes), row (text of each word), first (index of each text's first word)."""

    def __init__(self, column: pa.Array, lower: bool = False, sep: np.ndarray = _SEP):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        word = ~sep[self.data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        heads = self.offsets[:-1]
        before[heads[heads < n]] = False
        self.begin = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        tails = self.offsets[1:]
        after[tails[tails > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.is_word = word
        self.first = np.searchsorted(self.begin, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes from prefix sums, then mixed with its length."""
        n = len(self.data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
        h = (prefix[self.end] - prefix[self.begin]) * _powers(_BASE_INV, n + 1)[self.begin]
        return mix(h + (self.end - self.begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive words; the last k - 1 places are left out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i]) + np.uint64(i + 1)
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
