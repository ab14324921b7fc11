"""Words of Arrow text columns as 64-bit hashes, a block of documents at a time, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 those bytes
never occur inside another character.  Nothing here is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1024

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _STEP.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        have = _STEP[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


class Words:
    """The words of a few documents: ``hashes``, byte ``starts`` / ``ends``, and ``first[d]``: document d's first word."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, lower: bool = False):
        self.data, self.cuts = data, cuts
        inside = ~_GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        if len(data):
            before[0] = after[-1] = True
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, cuts)
        lengths = self.ends - self.starts
        heads = np.cumsum(lengths) - lengths
        letters = data[inside]
        if lower:
            letters = _LOWER[letters]
        place = np.arange(len(letters)) - np.repeat(heads, lengths)
        scaled = _BYTE[letters] * powers(0x9E3779B97F4A7C15, int(lengths.max(initial=0)) + 1)[place]
        sums = np.add.reduceat(scaled, heads) if len(heads) else np.zeros(0, np.uint64)
        self.hashes = mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def document(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def stretches(sizes: np.ndarray, most: int, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows whose sizes add up to at most ``most``, one row at least and ``rows`` at most."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = upto[start] - sizes[start]
        end = min(start + rows, max(start + 1, int(np.searchsorted(upto, base + most, "right"))), len(sizes))
        yield start, end
        start = end


def blocks(texts: pa.Array, lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[tuple[int, Words]]:
    """(first row, words) of consecutive rows of at most ``most`` bytes, one row at least; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for row, end in stretches(np.diff(cuts), most):
        yield row, Words(data[cuts[row]:cuts[end]], cuts[row:end + 1] - cuts[row], lower)


class Spans:
    """Hashes of any run of consecutive values, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray, base: int = 0xA0761D6478BD642F):
        n, inverse = len(values), pow(base, -1, 1 << 64)
        self.back = powers(inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        run = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(run + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
