"""Words and their hashes for whole Arrow batches: numpy over the texts' bytes, one call for many texts. Runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
PIECE = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
_OLD = np.seterr(over="ignore")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return lower, blank


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i below ``n`` at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


@dataclass
class Words:
    """Words of the texts of one piece: hash, start and end byte, and each text's first word (one more entry at the end)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    low: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, offs: np.ndarray, apart: np.ndarray | None = None) -> Words:
    """Words are runs of bytes that aren't ``apart`` (by default the blanks \\x20 and \\x09-\\x0D), with A-Z lower-cased."""
    lower, blank = _tables()
    low = lower[data]
    inside = ~(blank if apart is None else apart)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return Words(mix64((total[end] - total[start]) * down[start]), start, end, np.searchsorted(start, offs), low)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, repeats included, and each text's first; a text of fewer words, but not none, is one run."""
    count = np.diff(words.first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    place = np.repeat(words.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    length = np.repeat(np.minimum(count, n), runs)
    h = mix64(length.astype(np.uint64))
    for k in range(n):
        more = place + k < np.repeat(words.first[1:], runs)
        h = np.where(more & (k < length), mix64(h * BASE + words.hash[np.minimum(place + k, max(0, len(words.hash) - 1))]) if len(words.hash) else h, h)
    return h, first
