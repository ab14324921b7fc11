"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised to a codebook of their own; a cell is a pair of codewords.  For a
query, pairs of codewords are visited in order of the summed distances of the halves, until the visited
cells hold ``reach`` vectors; those are ranked by exact Euclidean distance.

How far to reach depends on the data: ``calibrated`` compares at most ``PROBES`` queries with all vectors and takes
the reach at which they would have met the wanted share of their true neighbours.

The codebooks are fitted on at most ``MAX_SAMPLE`` vectors; every vector is indexed.  Equal vectors are one entry that
keeps the few smallest ids a result could name, so that a vector owning a third of all rows is one
entry.  Cells are dealt into groups of at most ``MAX_GROUP`` numbers.  A query goes once to each group it visits, with one
bit for each of the group's cells; sorted by group, entries first, the rows pass as one stream through a task that holds one group
at a time and returns no more than the nearest few of each query.  Broadcast are the codebooks, the cell sizes and the
groups (at most ``MAX_CODES`` squared).  Vectors of floats stay floats until numbers are taken from them.

Edge cases: vectors that are null, zero, hold null or non-finite numbers, have a null id, or differ in length
from the most common length take no part.  Ids are of any type that has an order, and need not be unique: every row is a
candidate, so an id can be named more than once, and a query leaves out only its own row; the vectors that share a query's id are
queries of their own, rows equal in id and vector are one query.  Ties go to the smaller id; fewer than ``k`` candidates give fewer
rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from careframe.llm.common import free_shuffles, stored

MAX_SAMPLE = 16_384
MAX_CODES = 512
CELL = 32
ROUNDS = 12
GROUPS = 64
MIN_GROUP = 512
MAX_GROUP = 2 ** 22
PROBES = 64
HELD_ROWS = 500_000
SENT_ROWS = 4096
SCORES = 2 ** 21
BINS = 4096


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def doubles(name: str) -> Column:
    """For hashes: the same whether a vector is kept as floats or as doubles."""
    return F.col(name).cast("array<double>")


def sampled(rows: DataFrame, counted: int) -> np.ndarray:
    """The ``MAX_SAMPLE`` different vectors of smallest hash; those of larger hashes are left out before tasks send theirs."""
    mark, share = F.xxhash64(doubles("v")), 1.2 * MAX_SAMPLE / max(counted, 1)
    while True:
        some = rows if share >= 1 else rows.filter(mark <= F.lit(int(share * 2 ** 64) - 2 ** 63))
        found = some.select("v").distinct().orderBy(mark).limit(MAX_SAMPLE).collect()
        if share >= 1 or len(found) == MAX_SAMPLE:
            return _matrix(pa.array([r["v"] for r in found]))
        share *= 4


def codebook(points: np.ndarray, codes: int) -> np.ndarray:
    """Lloyd's rounds from a farthest-first start over a fixed shuffle."""
    points = points[np.random.Generator(np.random.PCG64(3)).permutation(len(points))]
    centres = points[:codes].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i:i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def visit(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, reach: int) -> np.ndarray:
    """Non-empty cells by rising sum of the halves' distances (ties: the nearer first half) until they hold ``reach`` vectors, in any order.

    Only the cells of the bin in which ``reach`` falls are sorted.
    """
    cells = np.flatnonzero(sizes)
    total, held = np.add.outer(first, second).ravel()[cells], sizes[cells]
    low, span = total.min(), np.ptp(total)
    bins = ((total - low) / span * (BINS - 1)).astype(np.int64) if 0 < span < math.inf else np.zeros(len(cells), np.int64)
    upto = np.cumsum(np.bincount(bins, held, BINS))
    edge = min(int(np.searchsorted(upto, reach)), BINS - 1)
    last = np.flatnonzero(bins == edge)
    a, b = (np.argsort(np.argsort(x, kind="stable")) for x in (first, second))
    last = last[np.lexsort((b[cells[last] % len(second)], a[cells[last] // len(second)], total[last]))]
    missing = reach - (upto[edge - 1] if edge else 0)
    return cells[np.concatenate([np.flatnonzero(bins < edge), last[:np.searchsorted(np.cumsum(held[last]), missing) + 1]])]


def grouped(sizes: np.ndarray, most: int):
    """Groups of about ``most`` entries at most: neighbouring cells share one, a larger cell is split.

    Returns (cell, its first group, number of groups, place in the group) of every non-empty cell, the cell of
    every bit of all groups' masks (the number of cells where a bit stands for none) and the first byte of each mask.
    """
    spans, bits, starts, room = [], [], [], 0
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if n > room:
            blocks = -(-n // most)
            for _ in range(blocks):
                bits += [len(sizes)] * (-len(bits) % 8)
                starts.append(len(bits) // 8)
                bits.append(cell)
            spans.append((cell, len(starts) - blocks, blocks, 0))
            room = most - n if blocks == 1 else 0
        else:
            spans.append((cell, len(starts) - 1, 1, len(bits) - starts[-1] * 8))
            bits.append(cell)
            room -= n
    bits += [len(sizes)] * (-len(bits) % 8)
    return spans, np.array(bits, np.int64), np.array([*starts, len(bits) // 8], np.int64)


def _kept_as(table: DataFrame, vector_col: str) -> str:
    return "array<float>" if table.select(F.col(vector_col)).dtypes[0][1] == "array<float>" else "array<double>"


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _nearest(found: dict[tuple, list[tuple]], id_type: pa.DataType):
    """The nearest of every query so far: a task sends no more than that of a query, unless it must empty its memory."""
    rows, kinds = ((*query, i, s) for query, mine in found.items() for s, i in mine), (id_type, pa.int64(), id_type, pa.float64())
    while some := list(itertools.islice(rows, SENT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some), kinds)], names=["query_id", "mark", "vec_id", "score"])


def _squares(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (points.astype(np.float64) ** 2).sum(1)


class Block:
    """Vectors with what comparing points with them needs of them alone."""

    def __init__(self, vectors: np.ndarray):
        norms = np.concatenate([_squares(vectors[i:i + 4096]) for i in range(0, len(vectors), 4096)])
        self.vectors, self.most = vectors, norms.max()
        kind = np.float32 if 1e-20 < self.most < 1e30 else np.float64
        self.wider = np.concatenate([vectors, norms[:, None]], axis=1, dtype=kind, casting="same_kind") if self.most < 1e300 else None

    def about(self, points: np.ndarray):
        """Squared distances less a number of each point, these numbers, and how far off they may be, for which a product of matrices will do."""
        squares = _squares(points)
        scale, terms = squares + self.most, points.shape[1] + 8
        if self.wider is None or not scale.max() < (1e30 if self.wider.dtype == np.float32 else 1e300):
            return np.array([((self.vectors - point) ** 2).sum(1) for point in points]), np.zeros(len(points)), np.zeros(len(points))
        wider = np.concatenate([-2 * points, np.ones((len(points), 1))], axis=1, dtype=self.wider.dtype, casting="same_kind")
        return wider @ self.wider.T, squares, (1e-6 if wider.dtype == np.float32 else 2e-15) * terms * scale

    @np.errstate(over="ignore")
    def near(self, points: np.ndarray, bounds: np.ndarray, most: int, seen: np.ndarray | None = None):
        """(point, vector, distance) of every seen vector that may be among the ``most`` nearest of a point (ties are all kept)
        and no farther than the point's bound, and a few more.  The distances are exact."""
        (about, less, slack), n = self.about(points), len(self.vectors)
        limit, most = bounds ** 2 * (1 + 1e-12) - less + slack, min(most, n)
        # The nearest of some are no nearer than those of all.
        some = slice(None, None, max(1, min(8, n // (16 * most))))
        few = about[:, some] if seen is None else np.where(seen[:, some], about[:, some], math.inf)
        if (wide := np.flatnonzero(np.count_nonzero(few <= limit[:, None], axis=1) > most)).size:
            least = np.partition(few[wide], most - 1, axis=1)[:, most - 1].astype(np.float64)
            limit[wide] = np.minimum(limit[wide], least + 1e-12 * np.abs(least) + 2 * slack[wide])
        taken = about <= np.nextafter(limit.astype(about.dtype), about.dtype.type(math.inf))[:, None]
        if seen is not None:
            taken &= seen
        point, vector = np.divmod(np.flatnonzero(taken), n)
        score, step = np.empty(len(point)), max(1, SCORES // points.shape[1])
        for i in range(0, len(point), step):
            score[i:i + step] = np.sqrt(((self.vectors[vector[i:i + step]] - points[point[i:i + step]]) ** 2).sum(1))
        upto, kept = np.searchsorted(point, np.arange(len(points) + 1)), score <= bounds[point]
        for i in np.flatnonzero(np.diff(upto) > 2 * most):
            mine = score[upto[i]:upto[i + 1]]
            kept[upto[i]:upto[i + 1]] &= mine <= np.partition(mine, most - 1)[most - 1]
        return point[kept], vector[kept], score[kept]


def merged(nearest_of: dict[tuple, list[tuple]], asks: pa.RecordBatch, block: Block, place: np.ndarray, ids: list[list], k: int) -> int:
    """Takes the entries of a group into the ``k`` nearest of each of the queries; returns how many rows those have grown by."""
    queries, points = list(zip(asks.column(1).to_pylist(), asks.column(2).to_pylist())), _matrix(asks.column(3))
    masks = np.frombuffer(b"".join(asks.column(4).to_pylist()), np.uint8).reshape(len(asks), -1)
    known = [nearest_of.get(query, ()) for query in queries]
    bounds = np.array([mine[-1][0] if len(mine) == k else math.inf for mine in known])
    query_at, entry, score = block.near(points, bounds, k + 1, np.unpackbits(masks, axis=1).view(bool).take(place, axis=1))
    grown, upto = 0, np.searchsorted(query_at, np.arange(len(queries) + 1)).tolist()
    entry, score = entry.tolist(), score.tolist()
    for i, (query, mine) in enumerate(zip(queries, known)):
        more = []
        for e, s in zip(entry[upto[i]:upto[i + 1]], score[upto[i]:upto[i + 1]]):
            others = ids[e]
            if not s and query[0] in others and (block.vectors[e] == points[i]).all():
                others = others.copy()
                others.remove(query[0])
            more += [(s, x) for x in others]
        if more:
            nearest_of[query] = sorted([*mine, *more])[:k]
            grown += len(nearest_of[query]) - len(mine)
    return grown


def calibrated(asked: DataFrame, entries: DataFrame, books, sizes: np.ndarray, k: int, recall: float) -> int:
    """Vectors to visit so that ``recall`` of the probes' true neighbours are met.  The probes are broadcast."""
    probes = asked.select("id", "v").orderBy(F.xxhash64("id", doubles("v"))).limit(PROBES).collect()
    if not probes:
        return k + 2
    points = np.array([r["v"] for r in probes])
    shared = entries.sparkSession.sparkContext.broadcast(points)

    def run(batches):
        for batch in batches:
            if len(batch):
                probe, entry, score = Block(_matrix(batch.column(0))).near(shared.value, np.full(len(shared.value), math.inf), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(score), batch.column(1).take(pa.array(entry))], names=["probe", "score", "cell"])

    order = Window.partitionBy("probe").orderBy("score", "cell")
    true = entries.select("v", "cell").mapInArrow(run, "probe long, score double, cell int").withColumn(
        "_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1).select("probe", "score", "cell").collect()
    (first, second), half, needed = books, books[0].shape[1], []
    for i, point in enumerate(points):
        total = (distances(point[None, :half], first)[0][:, None] + distances(point[None, half:], second)[0]).ravel()
        visited = np.argsort(total, kind="stable")
        upto = np.empty(len(sizes), np.int64)
        upto[visited] = np.cumsum(sizes[visited])
        needed += [upto[r["cell"]] for r in true if r["probe"] == i and r["score"] > 0]
    return max(k + 2, int(np.quantile(needed, recall, method="higher")) if needed else 0)


def search(table: DataFrame, queries: Column, k: int = 10, recall: float = 0.95, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest ``k`` found for every row that satisfies ``queries``, itself excepted.

    Runs jobs: entries are written to the shared folder, the sample and the cell sizes are read.
    """
    spark = table.sparkSession
    rows = table.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast(number := _kept_as(table, vector_col)).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    kind = rows.schema["id"].dataType.simpleString()
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if common is None:
        return empty
    rows = rows.filter(F.size("v") == common["n"]).groupBy("id", "v").agg(
        F.count("*").alias("copies"), F.max("asks").alias("asks"))
    rows = stored(rows, "ann-rows")
    # k + 1 smallest ids of a vector are enough: a result names k, and one may be the query itself.  Hashes go before
    # the vectors: they sort fast.  A window gathers the ids where they are; grouping by the vector would shuffle it again.
    order = Window.partitionBy("_hash", "v").orderBy("id")
    few = F.collect_list(F.struct("id", F.least("copies", F.lit(k + 1)).cast("int").alias("n"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    entries = rows.withColumn("_hash", F.xxhash64(doubles("v"))).withColumn("_place", F.row_number().over(order)).filter(
        F.col("_place") <= k + 1).withColumn("_few", few).filter(F.col("_place") == 1).select("v", F.slice(F.flatten(
            F.transform("_few", lambda x: F.array_repeat(x["id"], x["n"]))), 1, k + 1).alias("ids"))

    counted = rows.agg(F.count("*")).first()[0]
    sample = sampled(rows, counted)
    free_shuffles(spark)  # of what is stored by now
    half = common["n"] // 2
    codes = int(min(MAX_CODES, max(1, math.isqrt(counted // CELL)), len(sample)))
    books = spark.sparkContext.broadcast((codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)))

    def assign(batches):
        first, second = books.value
        for batch in batches:
            if len(batch):
                points = _matrix(batch.column(0))
                cells = nearest(points[:, :half], first) * len(second) + nearest(points[:, half:], second)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=["v", "ids", "cell"])

    entries = stored(entries.mapInArrow(assign, f"v {number}, ids array<{kind}>, cell int"), "ann-entries")
    sizes = np.zeros(codes * codes, np.int64)
    held = entries.groupBy("cell").count().collect()  # at most MAX_CODES squared rows
    for cell, n in held:
        sizes[cell] = n
    reach = calibrated(rows.filter("asks"), entries, books.value, sizes, k, recall)
    free_shuffles(spark)
    total = int(sizes.sum())
    spans, bits, starts = grouped(sizes, max(1, min(max(MIN_GROUP, total // GROUPS), MAX_GROUP // common["n"])))
    known = spark.sparkContext.broadcast((sizes, bits, starts))

    def probe(batches):
        (first, second), (sizes, bits, starts) = books.value, known.value
        step, cells = max(1, SENT_ROWS // (len(starts) - 1)), np.zeros(len(sizes) + 1, bool)
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, len(batch), step)):
                points, at, groups, seen = _matrix(part.column(2)), [], [], []
                for i, (x, y) in enumerate(zip(distances(points[:, :half], first), distances(points[:, half:], second))):
                    cells[:] = False
                    cells[visit(x, y, sizes, reach)] = True
                    masks = np.packbits(cells[bits])
                    mine = np.flatnonzero(np.bitwise_or.reduceat(masks, starts[:-1]))
                    masks = masks.tobytes()
                    at += [i] * len(mine)
                    groups += mine.tolist()
                    seen += [masks[a:b] for a, b in zip(starts[mine].tolist(), starts[mine + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), *[c.take(pa.array(at)) for c in part.columns], pa.array(seen, pa.binary())],
                                                 names=["group", "query", "mark", "v", "seen"])

    # The vectors that share an id are told apart by their hash.
    asked = rows.filter("asks").select("id", F.xxhash64(doubles("v")), "v").mapInArrow(
        probe, f"group int, query {kind}, mark long, v {number}, seen binary")
    spans = spark.createDataFrame(spans, "cell int, start int, blocks int, place int")
    held = entries.join(F.broadcast(spans), "cell").select(
        (F.col("start") + F.pmod(F.xxhash64(doubles("v")), "blocks")).cast("int").alias("group"), "v", "place", "ids")
    met = asked.unionByName(held, allowMissingColumns=True).repartition("group").sortWithinPartitions(
        "group", F.col("seen").isNotNull()).select("group", "query", "mark", "v", "seen", "place", "ids")

    def rank(batches):
        nearest_of: dict[tuple, list[tuple]] = {}
        held_rows, id_type, group, parts, entries = 0, None, None, [], None
        for batch in batches:
            if not len(batch):
                continue
            groups, asks, id_type = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False), batch.column(1).type
            ends = np.flatnonzero((groups[1:] != groups[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(batch)]):
                if groups[a] != group:
                    group, parts, entries = groups[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append((_matrix(part.column(3), None), part.column(5).to_numpy(), part.column(6).to_pylist()))
                    continue
                if parts:
                    v, place = (np.concatenate(x) for x in list(zip(*parts))[:2])
                    entries, parts = (Block(v), place, [x for _, _, ids in parts for x in ids]), []
                if entries is None:
                    continue  # a part of a split cell into which no entry fell
                step = max(1, SCORES // len(entries[1]))
                for some in (part.slice(i, step) for i in range(0, len(part), step)):
                    held_rows += merged(nearest_of, some, *entries, k)
                if held_rows > HELD_ROWS:
                    yield from _nearest(nearest_of, id_type)
                    nearest_of, held_rows = {}, 0
        yield from _nearest(nearest_of, id_type)

    found = met.mapInArrow(rank, f"query_id {kind}, mark long, vec_id {kind}, score double")
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
