"""Nearest neighbours against brute force: recall, repeated ids, ids of any type, ties, empty tables."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from careframe.llm import vectors

SCHEMA = "vec_id long, embedding array<double>"


def truth(rows, asks, k):
    """{(query id, its vector): [(score, id)]} with every other row as a candidate."""
    points, found = np.array([v for _, v in rows], float), {}
    for at, (id_, v) in enumerate(rows):
        if asks(id_):
            scores = np.sqrt(((points - points[at]) ** 2).sum(1))
            found[id_, tuple(v)] = sorted((float(s), rows[j][0]) for j, s in enumerate(scores) if j != at)[:k]
    return found


def clustered(n, rng):
    centres = rng.normal(size=(20, 16)) * 4
    return centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16))


@pytest.mark.parametrize("points", [lambda n, rng: rng.normal(size=(n, 16)), clustered], ids=["uniform", "clustered"])
def test_recall_against_brute_force(spark, points):
    made = points(3000, np.random.default_rng(5))
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    want = truth(rows, lambda i: i % 100 == 0, 10)
    got = {}
    for r in vectors.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    by_id = dict(rows)
    assert sorted(got) == [i for i, _ in sorted(want)]
    for query, mine in got.items():
        assert [r for r, _, _ in sorted(mine)] == list(range(1, 11))
        assert all(abs(s - np.linalg.norm(np.array(by_id[query]) - by_id[i])) < 1e-12 for _, i, s in mine)
    met = sum(len({i for _, i, _ in got[q]} & {i for _, i in near}) for (q, _), near in want.items())
    assert met / (10 * len(want)) >= 0.9


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.5]), (5, [1.0, 0.25]), (5, [1.0, 0.25]), (0, [9.0, 9.0]), (7, [1.0, 0.0])]
    found = vectors.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=5).collect()
    want = truth(rows, lambda i: i == 0, 5)
    assert sorted((r["rank"], round(r["score"], 9), r["vec_id"]) for r in found) == sorted(
        (n, round(s, 9), i) for near in want.values() for n, (s, i) in enumerate(near, 1))


def test_a_row_repeated_many_times_is_one_query_and_fills_the_ranks(spark):
    rows = [(0, [1.0, 1.0])] * 500 + [(1, [1.0, 2.0])]
    found = vectors.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]
    found = vectors.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 1, k=3).collect()
    assert [r["vec_id"] for r in found] == [0, 0, 0]


@pytest.mark.parametrize("kind, name", [("int", int), ("string", str), ("decimal(20,0)", __import__("decimal").Decimal)])
def test_ids_of_other_types(spark, kind, name):
    rows = [(name(i), [float(i), 1.0], "x") for i in range(8)]
    table = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>, score string")
    found = vectors.search(table, F.col("vec_id") == F.lit(name(0)), k=2).orderBy("rank")
    assert dict(found.dtypes)["vec_id"] == kind
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found.collect()] == [(name(0), name(1), 1.0), (name(0), name(2), 2.0)]


def test_empty_table_unequal_lengths_and_null_ids(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0]), (None, [1.0, 1.0]), (3, [1.0, None])], SCHEMA)
    assert [tuple(r) for r in vectors.search(table, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert vectors.search(table.limit(0), F.lit(True)).collect() == []
    assert vectors.search(table, F.lit(False)).collect() == []


def shuffled_bytes(plan):
    """Of all exchanges of a plan that has run."""
    name = plan.nodeName()
    under = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [
        plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("dataSize").get().value() if name == "Exchange" else 0
    return own + sum(map(shuffled_bytes, under))


def test_a_query_does_not_take_its_vector_to_every_cell_it_visits(spark):
    made = np.random.default_rng(7).normal(size=(2000, 256))
    found = vectors.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], SCHEMA), F.lit(True))
    assert len(found.collect()) == 20_000
    # 49 cells, few groups: about 6 times the vectors; with a vector for every cell visited it was 94 times.
    assert made.nbytes < shuffled_bytes(found._jdf.queryExecution().executedPlan()) < 10 * made.nbytes


def test_visited_cells_are_those_of_a_heap():
    def by_heap(first, second, sizes, reach):
        a, b, n = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
        found, held, heap, pushed = [], 0, [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
        while heap and held < reach:
            _, i, j = heapq.heappop(heap)
            cell = int(a[i]) * n + int(b[j])
            if sizes[cell]:
                found.append(cell)
                held += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < n and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
        return found

    rng = np.random.default_rng(3)
    for case in range(300):
        n = int(rng.integers(1, 40))
        first, second = (rng.integers(0, 9, n).astype(float) if case % 2 else rng.random(n) * 10.0 ** rng.integers(-9, 9) for _ in "ab")
        sizes = rng.integers(0, 50, n * n) * (rng.random(n * n) < 0.7)
        sizes[rng.integers(0, n * n)] = 7
        reach = int(rng.integers(1, sizes.sum() * 1.2 + 2))
        assert sorted(vectors.visit(first, second, sizes, reach).tolist()) == sorted(by_heap(first, second, sizes, reach))


def test_every_cell_has_its_groups_and_bits():
    sizes = np.array([0, 3, 2, 0, 25, 1, 10, 4, 0, 6, 5] + [1] * 30)
    spans, bits, starts = vectors.grouped(sizes, 10)
    assert [s[0] for s in spans] == np.flatnonzero(sizes).tolist()
    held = np.zeros(len(starts) - 1)
    for cell, start, blocks, place in spans:
        assert blocks == -(-sizes[cell] // 10)
        for group in range(start, start + blocks):
            held[group] += sizes[cell] / blocks
            assert bits[starts[group] * 8 + place] == cell and starts[group] * 8 + place < starts[group + 1] * 8
    assert held.max() <= 10 and len(bits) == starts[-1] * 8
    assert sorted(bits[bits < len(sizes)]) == sorted(s[0] for s in spans for _ in range(s[2]))


@pytest.mark.parametrize("kind, scale, shift", [
    *[(kind, *x) for kind in (np.float32, np.float64) for x in [(1, 0), (1, 1e4), (1e-3, 1e6), (1e-18, 0), (1e18, 0)]], (np.float64, 1e154, 0)])
def test_near_has_the_nearest_of_those_seen_whatever_the_numbers(kind, scale, shift):
    rng = np.random.default_rng(1)
    points, held = rng.normal(size=(30, 8)) * scale + shift, (rng.normal(size=(500, 8)) * scale + shift).astype(kind)
    seen = rng.random((30, 500)) < 0.5
    bounds = np.where(np.arange(30) % 3 == 0, 2.0 * scale, np.inf)
    with np.errstate(over="ignore"):
        exact = np.sqrt(((held[None] - points[:, None]) ** 2).sum(2))
        point, entry, score = vectors.Block(held).near(points, bounds, 11, seen)
    assert (score == exact[point, entry]).all() and seen[point, entry].all()
    for i in range(30):
        mine = np.where(seen[i], exact[i], np.inf)
        want = set(np.flatnonzero((mine <= np.sort(mine)[10]) & (mine <= bounds[i]) & seen[i]).tolist())
        assert want <= set(entry[point == i].tolist()) and (point == i).sum() <= max(44, len(want))


def test_small_groups_and_little_memory_give_the_same_rows(spark, monkeypatch):
    made = clustered(1500, np.random.default_rng(9))
    rows = [(i % 1400, v.tolist()) for i, v in enumerate(made)] + [(2000 + i, made[3].tolist()) for i in range(40)]
    table, asks = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0
    want = sorted(tuple(r) for r in vectors.search(table, asks).collect())
    for name, value in (("MIN_GROUP", 7), ("GROUPS", 10 ** 6), ("HELD_ROWS", 50), ("SENT_ROWS", 9)):
        monkeypatch.setattr(vectors, name, value)
    assert sorted(tuple(r) for r in vectors.search(table, asks).collect()) == want


def test_the_sample_is_the_same_whether_or_not_larger_hashes_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_SAMPLE", 50)
    few = spark.range(3000).selectExpr("array(cast(id % 200 as float), 1f) v")
    want = [r[0] for r in few.distinct().orderBy(F.xxhash64(F.col("v").cast("array<double>"))).limit(50).collect()]
    assert vectors.sampled(few, 3000).tolist() == want
