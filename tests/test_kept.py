"""As-of joins, search postings and catchment areas against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careframe.functions.predicates import search
from careframe.operators import asof, bucketed, catchments, governance, search_index


@pytest.mark.parametrize("slices", [64, 3])
def test_as_of_join_equals_brute_force_with_a_hot_key(spark, slices):
    rng = random.Random(slices)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None, *range(4, 60)])
    left = [(i, key(), rng.choice([None, *range(50)])) for i in range(400)]
    right = [(i, key(), rng.choice([None, *range(50)]), rng.choice([None, "a", "b"])) for i in range(500)]
    day = lambda c: F.expr(f"timestamp'2024-01-01' + make_dt_interval({c})").alias("t")
    lefts = spark.createDataFrame(left, "id int, key int, d int").select("id", "key", day("d"))
    rights = spark.createDataFrame(right, "no int, key int, d int, v string").select("no", "key", day("d"), "v")
    got = asof.as_of_join(lefts, rights, "key", "t", "t", "no", ["v", "no"], slices=slices)
    assert got.columns == ["id", "key", "t", "as_of"]

    def last(k, d):
        found = [(x, n, v) for n, k2, x, v in right if k is not None and d is not None and k2 == k and x is not None and x <= d]
        return (max(found)[2], max(found)[1]) if found else None

    have = {r["id"]: r["as_of"] and tuple(r["as_of"]) for r in got.collect()}
    assert have == {i: last(k, d) for i, k, d in left}


def test_consent_is_judged_at_the_time_of_each_row(spark):
    """Granted on day 1, withdrawn on day 5, renewed on day 9 until day 12."""
    history = [(1, 7, True, 1, None), (2, 7, False, 5, None), (3, 7, True, 9, 12), (4, 8, False, 3, None), (5, 8, True, 3, None)]
    changes = spark.createDataFrame(history, "id int, patient_key int, granted boolean, day int, until int").select(
        "id", "patient_key", F.lit("care").alias("consent_type"), "granted", F.date_add(F.lit("2024-01-01"), F.col("day")).cast("timestamp").alias("changed_at"),
        F.date_add(F.lit("2024-01-01"), F.col("until")).cast("timestamp").alias("expires_at"))
    other = changes.withColumns({"consent_type": F.lit("research"), "granted": F.lit(True), "expires_at": F.lit(None).cast("timestamp")})
    rows = spark.createDataFrame([(k, d) for k in (7, 8, 9) for d in range(15)], "patient_key int, day int").select(
        "patient_key", "day", F.date_add(F.lit("2024-01-01"), F.col("day")).cast("timestamp").alias("created_at"))
    got = governance.consented_then(rows, changes.unionAll(other), "care").collect()
    assert {(r["patient_key"], r["day"]) for r in got} == {(7, d) for d in (1, 2, 3, 4, 9, 10, 11)} | {(8, d) for d in range(3, 15)}


PEOPLE = [(f"P{i:04d}", ["Ann", "Éva", "Bo%b", "", None, "İz_zet", "annabel"][i % 7], f"07{i * 37 % 1000}") for i in range(300)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("search"))
    people = spark.createDataFrame(PEOPLE, "patient_id string, first_name string, phone string")
    bucketed.create(people, f"{root}/table", "patient_id", 8)
    search_index.build(spark, f"{root}/table", f"{root}/index", "patient_id", ["patient_id", "first_name", "phone"])
    return root, people


@pytest.mark.parametrize("text", ["0123", "p0", "É", "éva", "%", "_", "ANN", "nna", "9", "\u0000", "x", "07", "İz", "no one", "", None, "074 "])
@pytest.mark.parametrize("share", [0.2, 1000.0])
def test_indexed_search_equals_a_scan(spark, indexed, text, share):
    root, people = indexed
    columns = ["patient_id", "first_name", "phone"]
    got = search_index.search_indexed(spark, f"{root}/table", f"{root}/index", text, "patient_id", columns, scan_share=share)
    assert sorted(map(str, got.collect())) == sorted(map(str, search(people, text, columns).collect()))


def test_candidates_are_few_and_new_rows_are_found(spark, indexed, tmp_path):
    root, people = indexed
    assert search_index.candidates(spark, f"{root}/index", "P0123", ["patient_id"]).count() == 1
    found = search_index.search_indexed(spark, f"{root}/table", f"{root}/index", "P0123", "patient_id", ["patient_id"])
    assert re.search(r"PartitionFilters: \[[^\]]*bucket_of_8", found._jdf.queryExecution().toString())
    bucketed.create(people.withColumn("first_name", F.lit("Changed")), f"{tmp_path}/table", "patient_id", 8)
    search_index.build(spark, f"{root}/table", f"{tmp_path}/index", "patient_id", ["first_name"])
    search_index.extend(bucketed.read(spark, f"{tmp_path}/table"), f"{tmp_path}/index", "patient_id", ["first_name"])
    for text, n in (("hange", 300), ("anna", 0)):  # old postings are refuted
        assert search_index.search_indexed(spark, f"{tmp_path}/table", f"{tmp_path}/index", text, "patient_id", ["first_name"], scan_share=9.0).count() == n


SHAPES = {
    1: "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
    2: "POLYGON((4 0, 8 0, 8 4, 4 4))",  # shares an edge with 1, and is not closed
    3: "MULTIPOLYGON (((-3 -3, -1 -3, -2 -0.5, -3 -3)), ((5 -3, 7.3 -2.1, 6 -0.2, 5 -3)))",
    4: "polygon ((0.3 5.1, 9.7 5.1, 9.7 5.2, 0.3 5.2, 0.3 5.1))",  # thinner than a cell
    5: "LINESTRING (0 0, 1 1)", 6: None, 7: "POLYGON EMPTY", 8: "POLYGON ((0 4, 4 4, 2 9, 0 4))",
}


def crossings(wkt, x, y):
    n = 0
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        points = [tuple(map(float, p.split())) for p in ring.split(",")]
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
            (x1, y1), (x2, y2) = sorted(((ax, ay), (bx, by)), key=lambda p: p[1])
            n += y1 <= y < y2 and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
    return n


@pytest.mark.parametrize("cell", [0.25, 0.7, 3.0])
def test_catchments_equal_the_ray_test_of_every_place(spark, cell):
    points = [(y / 4, x / 4) for x in range(-16, 44) for y in range(-16, 40)] + [(5.15, 0.35), (5.1, 3.0), (5.2, 3.0)]
    places = spark.createDataFrame([(y, x, 2) for y, x in points] + [(1.0, 0.5, 5), (None, 1.0, 9)], "latitude double, longitude double, population long")
    areas = spark.createDataFrame(list(SHAPES.items()), "id int, catchment string")
    got = {r["area_id"]: (r["population"], r["places"]) for r in catchments.catchment_population(places, areas, cell_degrees=cell).collect()}
    for i, wkt in SHAPES.items():
        inside = [p for p in points if wkt and "POLYGON" in wkt.upper() and crossings(wkt, p[1], p[0]) % 2]
        assert got[i] == (2 * len(inside) + (5 if (1.0, 0.5) in inside else 0), len(inside)), i
    assert got[1][1] and got[2][1] == 256 and got[4][1] == 2
    # Every point of a shared edge is in exactly one of the two areas.
    edge = [p for p in points if p[1] == 4.0 and 0 <= p[0] < 4]
    assert all((crossings(SHAPES[1], 4.0, y) + crossings(SHAPES[2], 4.0, y)) % 2 for y, _ in edge)
