"""Places inside catchment areas given as WKT polygons.

A polygon's edges are read from its text, and it is listed under the grid cells it covers: cells that no edge touches are wholly inside or
outside, the others are edge cells.  Places are matched to cells by equality; only in edge cells a ray test decides, against the
edges that cross the cell's row of the grid.  All of it is column expressions, no pairs of places and polygons are formed.

A point is inside if a ray towards the east crosses an odd number of edges, over all rings: so holes are outside, and parts of a
multipolygon add up.  An edge spans from its lower end, included, to its upper end, excluded, and a point on an edge is not west
of it: of two areas that share an edge or a corner, exactly one has the points on it (that to the east or north of it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from careframe.operators.geo import _cell, _cell_number
from careframe.operators.keyed import spread_join

EDGE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def wkt_edges(wkt: Column) -> Column:
    """The edges of POLYGON or MULTIPOLYGON text (x is longitude, y latitude), lower end first.  Null for other text and empty polygons; a ring that is not closed is closed."""
    rings = F.regexp_extract_all(wkt, F.lit("\\(([^()]+)\\)"), F.lit(1))

    def point(text: Column) -> Column:
        parts = F.split(F.trim(text), "\\s+")
        return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))

    def edges(ring: Column) -> Column:
        points = F.transform(F.split(ring, ","), point)
        onward = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, 1, 1))

        def ordered(a: Column, b: Column) -> Column:
            low, high = F.when(a["y"] <= b["y"], a).otherwise(b), F.when(a["y"] <= b["y"], b).otherwise(a)
            return F.struct(low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"))

        return F.zip_with(points, onward, ordered)

    found = F.flatten(F.transform(rings, edges))
    return F.when(F.upper(F.ltrim(wkt)).rlike("^(MULTI)?POLYGON") & (F.size(found) > 0), found)


def crossing(edge: Column, y: Column) -> Column:
    """Where an edge is at latitude ``y``, null if it is level; the same number whichever ring the edge is read from."""
    return edge["x1"] + (y - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0)) * (edge["x2"] - edge["x1"])


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """The ray test."""
    east = F.filter(edges, lambda e: (e["y1"] <= y) & (y < e["y2"]) & (x < crossing(e, y)))
    return F.size(east) % 2 == 1


def cell_cover(areas: DataFrame, id_col: str = "id", wkt_col: str = "catchment", cell_degrees: float = 0.25) -> DataFrame:
    """(area_id, cell, edges): every cell an area touches; ``edges`` (those that cross the cell's row) is null where it is wholly inside."""
    size = F.lit(cell_degrees)

    def number(v: Column) -> Column:
        return F.floor(v / size).cast("long")

    def ends(k: str) -> Column:
        return F.transform("all", lambda e: e[k])

    shapes = areas.select(F.col(id_col).alias("area_id"), wkt_edges(F.col(wkt_col)).alias("all")).filter("all is not null")
    rows = shapes.withColumn("row", F.explode(F.sequence(number(F.array_min(ends("y1"))), number(F.array_max(ends("y2"))))))
    # A little wider than the row, in case rounding puts a place on its border into the next one.
    bottom, top = (F.col("row") - 1e-9) * size, (F.col("row") + 1 + 1e-9) * size
    rows = rows.select("area_id", "row", F.filter("all", lambda e: (e["y1"] < top) & (e["y2"] >= bottom)).alias("edges")).filter(F.size("edges") > 0)

    def touched(e: Column) -> Column:
        """The columns an edge passes through in this row, one more on either side against rounding."""
        a = F.coalesce(crossing(e, F.greatest(e["y1"], bottom)), e["x1"])
        b = F.coalesce(crossing(e, F.least(e["y2"], top)), e["x2"])
        return F.sequence(number(F.least(a, b)) - 1, number(F.greatest(a, b)) + 1)

    edge_cells = rows.withColumn("columns", F.array_distinct(F.flatten(F.transform("edges", touched))))
    on_edge = edge_cells.select("area_id", "row", F.explode("columns").alias("column"), "edges").select(
        "area_id", _cell_number(F.col("row"), F.col("column")).alias("cell"), "edges")
    # Between edge cells a row is inside or outside as its middle is.
    middle = (F.col("row") + 0.5) * size
    cuts = F.array_sort(F.transform(F.filter("edges", lambda e: (e["y1"] <= middle) & (middle < e["y2"])), lambda e: crossing(e, middle)))
    spans = edge_cells.withColumn("cuts", cuts).withColumn("pair", F.explode(F.when(
        F.size("cuts") >= 2, F.sequence(F.lit(0), F.size("cuts") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))))
    west, east = F.get("cuts", F.col("pair")), F.get("cuts", F.col("pair") + 1)
    inner = F.array_except(F.sequence(number(west), number(east)), F.col("columns"))
    inside = spans.select("area_id", "row", F.explode(inner).alias("column")).select(
        "area_id", _cell_number(F.col("row"), F.col("column")).alias("cell"), F.lit(None).cast(EDGE).alias("edges"))
    return on_edge.unionByName(inside)


def catchment_population(places: DataFrame, areas: DataFrame, id_col: str = "id", wkt_col: str = "catchment",
                         cell_degrees: float = 0.25) -> DataFrame:
    """(area_id, population, places) of every area: ``places`` holds ``latitude``, ``longitude`` and ``population``.

    Places of one coordinate are added up first and count as one; those without a coordinate are nowhere.  An area without
    a polygon, or with none of the places, has zeros.
    """
    located = places.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = located.groupBy("latitude", "longitude").agg(F.sum("population").alias("population")).withColumn(
        "cell", _cell(F.col("latitude"), F.col("longitude"), cell_degrees))
    near = spread_join(spots, cell_cover(areas, id_col, wkt_col, cell_degrees), "cell", unique=False)
    within = near.filter(F.col("edges").isNull() | contains_point(F.col("edges"), F.col("longitude"), F.col("latitude")))
    totals = within.groupBy("area_id").agg(F.sum("population").alias("population"), F.count("*").alias("places"))
    return areas.select(F.col(id_col).alias("area_id")).join(totals, "area_id", "left").fillna(0, ["population", "places"])
