"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of its byte pairs, damped and weighted by rarity; a truncated singular value
decomposition of a bounded sample of labelled texts gives the latent space.  The sample's latent
vectors are broadcast (``MAX_LABELLED`` x ``LATENT`` numbers at most), every document's exact cosine to
every one of them is computed block by block, and the ``NEIGHBOURS`` most similar vote with
their similarity.

Fitted on at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id; every document is scored.
Only the text enters a score.

Edge cases: a null text is the empty text; texts without byte pairs, and all texts if no label is
known, score the share of label 1 in the sample (0.5 without one); null labels are no labels, several labels
of one id are averaged; repeated rows score alike, and of several texts of one id the same one is learnt in every run; ids may be of any type; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from careframe.llm.common import text_batches, text_of
from careframe.llm.words import blocks

FEATURES = 2048
LATENT = 48
MAX_LABELLED = 4096
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.7
BLOCK_ROWS = 256

_PAIR = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)


def pair_counts(texts: pa.Array):
    """(first row, matrix of damped byte-pair counts) of consecutive rows."""
    for row, words in blocks(texts):
        data, cuts = words.data, words.cuts
        for start in range(0, len(words), BLOCK_ROWS):
            part = cuts[start:start + BLOCK_ROWS + 1]
            piece = data[part[0]:part[-1]].astype(np.int64)
            rows, n = np.repeat(np.arange(len(part) - 1), np.diff(part)), len(part) - 1
            if len(piece) < 2:
                yield row + start, np.zeros((n, FEATURES))
                continue
            same = rows[1:] == rows[:-1]
            at = (rows[:-1] * FEATURES + _PAIR[piece[:-1] * 256 + piece[1:]])[same]
            yield row + start, np.log1p(np.bincount(at, minlength=n * FEATURES).reshape(n, FEATURES))


class Model:
    """Projection into the latent space, the sample's unit vectors there, and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels
        if not len(labels):
            return
        seen = (counts > 0).sum(0)
        self.rarity = (np.log((len(labels) + 1) / (seen + 1)) + 0.1).astype(np.float32)
        weighted = self._unit(counts * self.rarity)
        basis = np.random.Generator(np.random.PCG64(7)).standard_normal((FEATURES, min(LATENT + 16, FEATURES))).astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
        _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
        self.axes = basis @ right[:LATENT].T
        self.points = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        points = self._unit(self._unit(counts * self.rarity) @ self.axes)
        cosine = points @ self.points.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 0, None) ** POWER
        total = weight.sum(1)
        votes = (weight * self.labels[near]).sum(1)
        return np.clip(np.divide(votes, total, out=np.full(len(counts), self.prior), where=total > 1e-12), 0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: those whose crc32 of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of labelled rows that are not held out.  Runs one job, which returns the sample's counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id")).groupBy("id").agg(F.avg("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("id"))
    sample = known.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # Broadcast: at most MAX_LABELLED rows of two numbers.  Of an id's different texts the one with the smallest digest is learnt; copies
    # are dropped map-side, before anything is counted.
    one = F.min(F.struct(F.md5("text").alias("digest"), "text"))
    chosen = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(one.alias("x")).select(
        F.xxhash64("id").alias("place"), F.col("id").cast("string").alias("id"), "label", "x.text")

    def run(batches):
        for batch in batches:
            for row, counts in pair_counts(batch.column(3)):
                part = batch.slice(row, len(counts))
                packed = pa.array([x.astype(np.float32).tobytes() for x in counts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), packed], names=["place", "id", "label", "x"])

    rows = text_batches(chosen).mapInArrow(run, "place long, id string, label double, x binary").collect()
    rows.sort(key=lambda r: (r["place"], r["id"]))
    labels, counts = np.array([r["label"] for r in rows]), np.empty((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(r["x"], np.float32)
    del rows
    return Model(counts, labels)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` between 0 and 1 for every row, in place of any column of that name."""
    keep = [c for c in docs.columns if c != score_col]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), keep.index(text_col)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(counts) for _, counts in pair_counts(batch.column(at))]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*keep, score_col])

    fields = [docs.schema[c] for c in keep]
    return text_batches(docs.select(*[docs[f"`{c}`"] for c in keep])).mapInArrow(
        run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))
