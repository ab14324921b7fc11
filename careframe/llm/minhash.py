"""DartMinHash signatures of weighted shingle sets, in numpy.

A document is the set of its five-word shingles with weights: how often each occurs, or 1 each.  Element and
weight span a strip; darts fall on (weight, rank) cells of every strip at unit density, placed by hashes of
element and cell alone, so that equal regions of two documents hold equal darts.  A document takes the
darts within its weights up to the rank at which ``darts`` are expected in total, deals them to
``coordinates`` by hash, and keeps the earliest of each.  Two documents agree on a coordinate
with the probability of their weighted Jaccard similarity.  With weights of 1 that is the plain Jaccard similarity
near-duplicates are defined by; weights by count would make documents alike that only share a phrase repeated hundreds of times.
"""

from __future__ import annotations

import math

import numpy as np

from careframe.llm.words import Spans, Words, mix

SHINGLE = 5
COORDINATES = 66
# Rank cells: halves towards zero below 1, then unit cells.
SMALL_CELLS = 6
MOST_DARTS = 12
# 64-bit words of a parity sketch.
SKETCH_WORDS = 16
_TAKE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def expected_darts(coordinates: int = COORDINATES) -> float:
    return coordinates * (math.log(coordinates) + 2)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, in order; a text of one to four words is one shingle."""
    h, doc = words.hashes, words.document()
    spans, n = Spans(h), len(h)
    starts = np.arange(max(0, n - SHINGLE + 1))
    starts = starts[doc[starts] == doc[starts + SHINGLE - 1]] if len(starts) else starts
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    begin = np.concatenate([starts, words.first[short]])
    end = np.concatenate([starts + SHINGLE, words.first[short] + counts[short]])
    found, owner = spans.hashes(begin, end), np.concatenate([doc[starts], short])
    order = np.argsort(owner, kind="stable")
    return owner[order], found[order]


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, number of the occurrence): an element of weight w gives occurrences 0 .. w-1."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner, hashes, np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))


def cell(i: int) -> tuple[float, float]:
    """Lower and upper rank of cell i."""
    if i <= SMALL_CELLS:
        top = 2.0 ** (i - SMALL_CELLS)
        return (0.0 if i == 0 else top / 2, top)
    return float(i - SMALL_CELLS), float(i - SMALL_CELLS + 1)


def signatures(owner: np.ndarray, element: np.ndarray, nth: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """n x coordinates earliest darts, 0 where none fell; one unit of weight per (document, element, occurrence)."""
    sizes = np.bincount(owner, minlength=n)
    limit = expected_darts(coordinates) / np.maximum(sizes, 1)
    strip = mix(element + nth.astype(np.uint64) * _TAKE)
    bound = limit[owner]
    at, rank, dart = [], [], []
    i, alive = 0, np.arange(len(owner))
    while len(alive):
        low, high = cell(i)
        alive = alive[bound[alive] > low]
        if not len(alive):
            break
        seed = mix(strip[alive] + np.uint64((i + 1) * 0xD1B54A32D192ED03 & MASK))
        chance = (seed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        area, upto, share = high - low, 0.0, math.exp(-(high - low))
        for d in range(MOST_DARTS):  # dart d exists where the Poisson count exceeds d
            upto += share
            share *= area / (d + 1)
            hit = chance >= upto
            if not hit.any():
                break
            one = mix(seed[hit] + np.uint64((d + 1) * 0xA24BAED4963EE407 & MASK))
            r = low + area * ((one >> np.uint64(11)).astype(np.float64) / float(1 << 53))
            mine = owner[alive[hit]]
            good = r <= limit[mine]
            one, r, mine = one[good], r[good], mine[good]
            id_ = mix(one ^ np.uint64(0x589965CC75374CC3))
            at.append(mine * coordinates + (id_ % np.uint64(coordinates)).astype(np.int64))
            rank.append(r)
            dart.append(id_ | np.uint64(1))
        i += 1
    out = np.zeros(n * coordinates, np.uint64)
    if at:
        at, rank, dart = np.concatenate(at), np.concatenate(rank), np.concatenate(dart)
        order = np.lexsort((rank, at))
        at, dart = at[order], dart[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        out[at[first]] = dart[first]
    return out.reshape(n, coordinates)


def region(words: Words, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of weight (document, element, occurrence) of every document: all occurrences, or the first only."""
    owner, element, nth = weighted(*shingles(words))
    return (owner, element, nth) if by_count else tuple(x[nth == 0] for x in (owner, element, nth))


def bands(words: Words, rows: int, by_count: bool = False, coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, the document's units of weight) of every full band of ``rows`` coordinates."""
    units = region(words, by_count)
    signature = signatures(*units, len(words), coordinates)
    docs, hashes = [], []
    for band in range(coordinates // rows):
        part = signature[:, band * rows:(band + 1) * rows]
        full = (part != 0).all(1)
        h = np.full(full.sum(), band + 1, np.uint64)
        for j in range(rows):
            h = mix(h * _TAKE + part[full, j])
        docs.append(np.flatnonzero(full))
        hashes.append(h)
    doc = np.concatenate(docs)
    return doc, np.concatenate(hashes), np.bincount(units[0], minlength=len(words))[doc]


def parities(units: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """n x SKETCH_WORDS words whose bits tell whether an odd number of the document's units fell on them.

    A unit that two documents do not share changes one bit, so they differ in at least as many units as in bits.
    """
    owner, element, nth = units
    n_bits = 64 * SKETCH_WORDS
    bit = (mix(element + nth.astype(np.uint64) * _TAKE) % np.uint64(n_bits)).astype(np.int64)
    odd = (np.bincount(owner * n_bits + bit, minlength=n * n_bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, n_bits), axis=1).view(np.int64)


def similarity(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of n pairs of regions."""
    owner, element, nth = (np.concatenate(x) for x in zip(first, second))
    order = np.lexsort((nth, element, owner))
    owner, element, nth = owner[order], element[order], nth[order]
    both = (owner[1:] == owner[:-1]) & (element[1:] == element[:-1]) & (nth[1:] == nth[:-1])
    shared = np.bincount(owner[1:][both], minlength=n)
    every = np.bincount(owner, minlength=n) - shared
    return np.divide(shared, every, out=np.zeros(n), where=every > 0)
