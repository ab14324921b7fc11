"""Right-closed binning: edges, interval labels and the binning expression."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
from pyspark.sql import Column, functions as F

# Edges of the encoded age groups (codes 0, 1, 2, ...).
AGE_CODE_EDGES = (0, 15, 20, 25, 30, 35, 40, 50, 100)

LABEL_DIGITS = 3


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """``bins`` equal widths from ``low`` to ``high``, the first edge lowered a
    little so that ``low`` itself falls inside; a constant column is widened on
    both sides first."""
    if math.isinf(low) or math.isinf(high):
        raise ValueError("cannot bin a column that holds infinity into equal widths")
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        return [float(e) for e in np.linspace(low - margin, high + margin, bins + 1)]
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    edges[0] -= (high - low) * 0.001
    return edges


def interval_labels(edges: list) -> list[str]:
    """``(a, b]`` text per bin, with the fewest decimals that keep edges apart.

    An edge shows decimals from one on and significant digits below one, ``LABEL_DIGITS`` at least.  One
    fractional edge makes all of them print as fractions; whole edges print as they are.
    """
    if all(isinstance(edge, int) for edge in edges):
        texts = [str(edge) for edge in edges]
    else:
        texts = next(found for found in (_edge_texts(edges, n) for n in count(LABEL_DIGITS)) if len(set(found)) == len(set(edges)))
    return [f"({low}, {high}]" for low, high in zip(texts, texts[1:])]


def _edge_texts(edges: list, digits: int) -> list[str]:
    return [str(float(format(float(edge), f".{digits}{'f' if abs(edge) >= 1 else 'g'}"))) for edge in edges]


def cut(value: Column, edges: list, labels: list | None = None) -> Column:
    """Label of the right-closed bin holding ``value``; outside all bins gives null.

    Without labels the label is the interval text.
    """
    labels = interval_labels(list(edges)) if labels is None else list(labels)
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    inside = (value > F.lit(edges[0])) & (value <= F.lit(edges[-1]))
    chain = F.when(value.isNull() | ~inside, F.lit(None))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(value <= F.lit(upper), F.lit(label))
    return chain


def age_code(age: Column) -> Column:
    return cut(age, list(AGE_CODE_EDGES), list(range(len(AGE_CODE_EDGES) - 1)))
