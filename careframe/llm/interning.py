"""Word n-grams of text batches, interned in an open-addressed NumPy table.

A word is a maximal run of ASCII letters, digits and any character beyond ASCII; only A-Z are lower-cased.  The words of a
block of texts are laid out one after the other with one space between, so that every run of consecutive words
is one stretch of bytes.  Nothing here is done per occurrence in Python, except for words of 32 bytes and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from careframe.llm.words import stretches

BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True

# The five primes of 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def byte_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, cuts) of consecutive rows of at most ``most`` bytes, one row at least; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for row, end in stretches(np.diff(cuts), most):
        yield row, data[cuts[row]:cuts[end]], cuts[row:end + 1] - cuts[row]


class WordRuns:
    """The words of a few texts: joined ``data``, ``starts`` / ``ends`` of words in it, ``first[d]``: text d's first word."""

    def __init__(self, raw: np.ndarray, cuts: np.ndarray):
        inside = _IN_WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[cuts] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        heads = np.flatnonzero(inside & before)
        lengths = np.flatnonzero(inside & after) + 1 - heads
        self.first = np.searchsorted(heads, cuts)
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.ends = self.starts + lengths
        # Eight spare bytes, so that a word's last eight-byte lane can be read whole.
        self.data = np.full(int(lengths.sum()) + len(lengths) + 8, 32, np.uint8)
        letters = _LOWER[raw[inside]]
        self.data[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first) of all runs of ``n`` words inside one text; ``first`` as for words."""
        counts = np.maximum(np.diff(self.first) - (n - 1), 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        return self.starts[at], self.ends[at + n - 1], first


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """``data`` read as little-endian numbers at every byte offset."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(data) - width + 1,), kind, data, 0, (1,))


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit xxHash (seed 0) of stretches of ``data``, which ends in eight spare bytes."""
    lengths, out = ends - starts, np.empty(len(starts), np.uint64)
    eights, fours = _lanes(data, "<u8"), _lanes(data, "<u4")
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(np.minimum(lengths, 32)[order], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(32):
            rows = order[bounds[n]:bounds[n + 1]]
            if not len(rows):
                continue
            at = starts[rows]
            h = np.full(len(rows), _P5 + np.uint64(n), np.uint64)
            done = 0
            while n - done >= 8:
                h = _turn(h ^ (_turn(eights[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if n - done >= 4:
                h = _turn(h ^ (fours[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < n:
                h = _turn(h ^ (data[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[rows] = h ^ (h >> np.uint64(32))
    whole = memoryview(data)
    for row in order[bounds[32]:].tolist():
        out[row] = xxhash.xxh64_intdigest(whole[starts[row]:ends[row]])
    return out


def same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``lengths`` bytes at ``left`` and ``right`` are equal."""
    same, eights = np.ones(len(left), bool), _lanes(data, "<u8")
    short = np.flatnonzero(lengths < 32)
    for done in range(0, 32, 8):
        short = short[lengths[short] > done]
        rest = np.minimum(lengths[short] - done, 8).astype(np.uint64)
        unused = np.uint64(64) - np.uint64(8) * rest
        same[short] &= ((eights[left[short] + done] ^ eights[right[short] + done]) << unused) == 0
    whole = memoryview(data)
    for row in np.flatnonzero(lengths >= 32).tolist():
        a, b, n = int(left[row]), int(right[row]), int(lengths[row])
        same[row] = whole[a:a + n] == whole[b:b + n]
    return same


class Table:
    """The different stretches among (starts, ends), each in a slot of its own, found by hash and verified by bytes.

    ``slots`` has the slot id of every occurrence; ``used`` the taken slots, ``owner`` an occurrence for each of them
    and ``counts`` how many occurrences they have.  Probing is linear and done for all unsettled occurrences at once.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None):
        keys = xxhash64(data, starts, ends) if keys is None else keys
        self.size = 1 << max(3, (2 * len(keys) - 1).bit_length())
        mask, holder = np.uint64(self.size - 1), np.full(self.size, -1, np.int64)
        self.slots = (keys & mask).astype(np.int64)
        lengths, todo = ends - starts, np.arange(len(keys))
        while len(todo):
            at = self.slots[todo]
            free = holder[at] < 0
            holder[at[free]] = todo[free]  # of several occurrences that claim a slot, one stays
            held = holder[at]
            alike = (keys[held] == keys[todo]) & (lengths[held] == lengths[todo])
            other = np.flatnonzero(alike & (held != todo))
            alike[other] = same_bytes(data, starts[held[other]], starts[todo[other]], lengths[todo[other]])
            todo = todo[~alike]
            self.slots[todo] = (self.slots[todo] + 1) & (self.size - 1)
        self.used = np.flatnonzero(holder >= 0)
        self.owner = holder[self.used]
        self.counts = np.bincount(self.slots, minlength=self.size)[self.used]
