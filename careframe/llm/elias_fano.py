"""Monotone sequences in Elias-Fano form, and an n-gram trie level made of them.

A level keeps contexts, pointers and words as three monotone sequences in one anonymous memory map: the
words of context number r are stored as r * 2**32 + word, which makes them monotone over the whole level, and a word is
found by successor search between the context's two pointers.
"""

from __future__ import annotations

import mmap

import numpy as np

EXACT = 4096  # frequencies up to here are their own code
STEP = 1 / 6000  # of the quantised log10 beyond


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bytes as they are, high parts in unary."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, bits: np.ndarray):
        self.n, self.low_bytes, self.low, self.bits = n, low_bytes, low, bits
        self._directory = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bytes = min(range(8), key=lambda b: 8 * b * n + (top >> (8 * b)))
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :low_bytes].copy()
        high = (values >> np.uint64(8 * low_bytes)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, low_bytes, low.reshape(-1), np.packbits(bits))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bytes], "<i8").tobytes() + self.low.tobytes() + self.bits.tobytes()

    @classmethod
    def from_buffer(cls, data) -> EliasFano:
        n, low_bytes = (int(x) for x in np.frombuffer(data, "<i8", 2))
        low = np.frombuffer(data, np.uint8, n * low_bytes, 16)
        return cls(n, low_bytes, low, np.frombuffer(data, np.uint8, offset=16 + n * low_bytes))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[at * self.low_bytes + b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.bits))[:self.n] - np.arange(self.n)
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._lows(np.arange(self.n))

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at given places."""
        if self._directory is None:
            self._search()
        high = np.searchsorted(self._directory, places, "right") - 1
        return (high.astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._lows(places)

    def _search(self) -> None:
        # First element of every high part: where the zeros of the unary part stand.
        zeros = np.flatnonzero(np.unpackbits(self.bits) == 0)
        self._directory = np.minimum(np.concatenate([[0], zeros - np.arange(len(zeros))]), self.n)

    def successor(self, wanted: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Place of the first value at or above each wanted one, within [low, high) if given; ``high`` if there is none."""
        if self._directory is None:
            self._search()
        part = wanted >> np.uint64(8 * self.low_bytes)
        most = len(self._directory) - 2
        inside = part <= np.uint64(most)
        part = np.minimum(part, np.uint64(most)).astype(np.int64)
        begin = np.where(inside, self._directory[part], self.n)
        end = np.where(inside, self._directory[part + 1], self.n)
        if low is not None:
            begin, end = np.clip(begin, low, high), np.clip(end, low, high)
        rest = wanted & np.uint64((1 << (8 * self.low_bytes)) - 1)
        while (open_ := begin < end).any():
            middle = (begin + end) // 2
            less = np.zeros(len(wanted), bool)
            at = np.flatnonzero(open_)
            less[at] = self._lows(middle[at]) < rest[at]
            begin = np.where(open_ & less, middle + 1, begin)
            end = np.where(open_ & ~less, middle, end)
        return begin


class Level:
    """Second or later level of a trie: the words that follow each context, with quantised frequencies."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """``keys``: sorted context * 2**32 + word; ``counts``: how often, above zero."""
        contexts = keys >> np.uint64(32)
        new = np.ones(len(keys), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        first = np.flatnonzero(new)
        rank = (np.cumsum(new) - 1).astype(np.uint64)
        parts = [EliasFano.of(contexts[first]), EliasFano.of(np.append(first, len(keys))),
                 EliasFano.of((rank << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)))]
        blobs = [*(p.to_bytes() for p in parts), quantised(counts).tobytes()]
        self.map = mmap.mmap(-1, max(1, sum(map(len, blobs))))
        view, at, pieces = memoryview(self.map), 0, []
        for blob in blobs:
            view[at:at + len(blob)] = blob
            pieces.append(view[at:at + len(blob)])
            at += len(blob)
        self.contexts, self.pointers, self.words = (EliasFano.from_buffer(p) for p in pieces[:3])
        self.codes = np.frombuffer(pieces[3], np.uint16)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key, 0 where the n-gram was not seen."""
        out = np.zeros(len(keys), np.uint16)
        if not len(self.codes) or not len(keys):
            return out
        context = keys >> np.uint64(32)
        rank = self.contexts.successor(context)
        some = np.flatnonzero(rank < self.contexts.n)
        some = some[self.contexts.at(rank[some]) == context[some]]
        rank = rank[some]
        low, high = self.pointers.at(rank).astype(np.int64), self.pointers.at(rank + 1).astype(np.int64)
        wanted = (rank.astype(np.uint64) << np.uint64(32)) | (keys[some] & np.uint64(0xFFFFFFFF))
        place = self.words.successor(wanted, low, high)
        hit = np.flatnonzero(place < high)
        hit = hit[self.words.at(place[hit]) == wanted[hit]]
        out[some[hit]] = self.codes[place[hit]]
        return out


def quantised(counts: np.ndarray) -> np.ndarray:
    """16-bit codes of frequencies, accurate to 0.02 percent."""
    steps = np.rint(np.log10(np.maximum(counts, EXACT) / EXACT) / STEP)
    return np.where(counts <= EXACT, counts, EXACT + np.minimum(steps, 65535 - EXACT)).astype(np.uint16)


def frequency(codes: np.ndarray) -> np.ndarray:
    """Frequencies behind the codes."""
    codes = codes.astype(np.float64)
    return np.where(codes <= EXACT, codes, EXACT * 10.0 ** ((codes - EXACT) * STEP))
