import math
import random

import pytest
from pyspark.sql import functions as F

from feederlake.functions import shapes
from feederlake.functions.calendar import winter_label
from feederlake.functions.hexgrid import EDGE_M, cell_id, cell_ring, centre_x, centre_y
from feederlake.functions.projection import lat_degrees, lon_degrees, with_metres
from feederlake.operators.spatial import (
    clipped_length_m,
    contains_point,
    edges_apart,
    edges_literal,
    join_containing,
    join_within,
    polygon_cells,
    ring_edges,
    touches_point,
    touches_segment,
    with_cuts,
)

SQUARE = [[(-74.0, 46.0), (-73.0, 46.0), (-73.0, 47.0), (-74.0, 47.0), (-74.0, 46.0)]]


def value(spark, expression, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], names).selectExpr(f"{expression} AS v").first().v \
        if columns else spark.sql(f"SELECT {expression} AS v").first().v


def test_projection_matches_the_check_point(spark):
    row = with_metres(spark.sql("SELECT -73.735D lon, 45.605D lat")).first()
    assert (row.x, row.y) == pytest.approx((-408368.9700, 193778.8396), abs=1e-3)


def test_projection_and_back(spark):
    df = spark.range(2000).selectExpr("-80D + (id * 7 % 2300) / 100D AS lon", "44D + (id * 13 % 1900) / 100D AS lat")
    back = with_metres(df).selectExpr(f"abs({lon_degrees('x', 'y')} - lon) AS a", f"abs({lat_degrees('x', 'y')} - lat) AS b")
    worst = back.agg(F.max("a"), F.max("b")).first()
    assert max(worst) < 1e-9


@pytest.mark.parametrize("resolution", [8, 9])
def test_every_point_is_in_its_cell_and_cells_have_the_hexagon_area(spark, resolution):
    df = spark.range(3000).selectExpr("id * 977 % 40000 - 20000D AS x", "id * 613 % 40000 - 20000D AS y")
    cells = df.selectExpr("x", "y", f"{cell_id('x', 'y', resolution)} AS cell")
    edge = EDGE_M[resolution]
    far = cells.selectExpr(f"sqrt(pow(x - {centre_x('cell')}, 2) + pow(y - {centre_y('cell')}, 2)) AS d")
    assert far.agg(F.max("d")).first()[0] <= edge * (1 + 1e-9)
    again = cells.selectExpr("cell", f"{centre_x('cell')} AS x", f"{centre_y('cell')} AS y").filter(
        f"{cell_id('x', 'y', resolution)} <> cell")
    assert again.count() == 0
    ring = cells.limit(1).selectExpr(f"array({cell_ring('cell')}) AS r").selectExpr(
        f"{shapes.polygon_area_m2('r')} AS a").first().a
    assert ring == pytest.approx(1.5 * math.sqrt(3) * edge * edge, rel=1e-6)


def test_winter_label(spark):
    days = spark.sql("SELECT explode(array(date'2024-12-01', date'2025-03-31', date'2025-04-01')) AS d")
    assert [r[0] for r in days.select(winter_label(F.col("d"))).collect()] == ["Hiver 2025", "Hiver 2025", None]


@pytest.mark.parametrize("lon,lat,contained,touching", [
    (-73.5, 46.5, True, True), (-74.0, 46.5, False, True), (-74.0, 46.0, False, True), (-73.5, 47.0, False, True),
    (-75.0, 46.5, False, False), (-73.5, 47.1, False, False),
])
def test_the_outline_is_touched_but_not_contained(spark, lon, lat, contained, touching):
    e = edges_literal(SQUARE)
    assert value(spark, contains_point(e, "lon", "lat"), lon=lon, lat=lat) is contained
    assert value(spark, touches_point(e, "lon", "lat"), lon=lon, lat=lat) is touching


def test_holes_are_outside(spark):
    hole = [(-73.6, 46.4), (-73.4, 46.4), (-73.4, 46.6), (-73.6, 46.6), (-73.6, 46.4)]
    assert value(spark, contains_point(edges_literal([*SQUARE, hole]), "lon", "lat"), lon=-73.5, lat=46.5) is False


@pytest.mark.parametrize("segment,touching,share", [
    ((-73.9, 46.5, -73.1, 46.5), True, 1.0), ((-74.5, 46.5, -73.5, 46.5), True, 0.5),
    ((-74.5, 46.5, -72.5, 46.5), True, 0.5), ((-74.5, 47.5, -73.5, 47.5), False, 0.0),
    ((-74.0, 46.2, -74.0, 46.8), True, 1.0), ((-75.0, 46.0, -74.0, 46.0), True, 0.0),
])
def test_clipping(spark, segment, touching, share):
    names = ("lon1", "lat1", "lon2", "lat2")
    df = spark.createDataFrame([segment], list(names)).selectExpr("*", f"{edges_literal(SQUARE)} AS _edges")
    assert df.selectExpr(f"{touches_segment('_edges', *names)} AS v").first().v is touching
    clipped = with_cuts(df, *names).selectExpr(f"{clipped_length_m('_edges', '_cuts', *names)} AS v").first().v
    ends = with_metres(with_metres(df, "lon1", "lat1", "x1", "y1"), "lon2", "lat2", "x2", "y2").first()
    whole = math.hypot(ends.x2 - ends.x1, ends.y2 - ends.y1)
    assert clipped == pytest.approx(whole * share, rel=2e-3, abs=1e-6)


@pytest.mark.parametrize("wkt,valid", [
    ("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", True),
    ("POLYGON((0 0, 4 0, 4 4, 0 4))", False),          # not closed
    ("POLYGON((0 0, 4 4, 4 0, 0 4, 0 0))", False),     # crosses itself
    ("POLYGON((0 0, 4 0, 8 0, 0 0))", False),          # no area
    ("POLYGON((0 0, 4 0, 0 0))", False),
    ("POINT(1 2)", False),
])
def test_polygon_validity(spark, wkt, valid):
    df = spark.createDataFrame([(wkt,)], "w string").selectExpr(f"{shapes.rings_from_wkt('w')} AS r")
    sound = f"CASE WHEN {shapes.rings_well_formed('r')} THEN {edges_apart('r')} ELSE false END"
    assert df.selectExpr(f"{sound} AS v").first().v is valid


def test_geojson_polygon_is_read_back(spark):
    text = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}'
    df = spark.createDataFrame([(text,)], "t string").selectExpr(f"{shapes.rings_from_geojson('t')} AS r")
    assert df.selectExpr(f"{shapes.polygon_geojson('r')} AS g").first().g == (
        '{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]]]}')
    assert shapes.rings_literal(text)[0][2] == (4.0, 4.0)
    assert df.selectExpr(f"{shapes.polygon_wkt('r')} AS w").first().w == (
        "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0))")


def test_grid_joins_equal_brute_force(spark):
    points = spark.range(4000).selectExpr("id", "-75D + (id * 37 % 3001) / 1000D AS lon", "45.5D + (id * 91 % 2003) / 1000D AS lat")
    polygons = spark.createDataFrame(
        [("a", "POLYGON((-74 46, -73 46, -73 47, -74 47, -74 46))"), ("b", "POLYGON((-74.5 45.6, -73.2 46.9, -74.6 46.8, -74.5 45.6))")],
        "name string, w string").selectExpr("name", f"{shapes.rings_from_wkt('w')} AS r")
    got = join_containing(points, polygons, "r").select("id", "name")
    brute = points.join(polygons.selectExpr("name", f"{ring_edges('r')} AS e"), F.expr(contains_point("e", "lon", "lat")))
    want = brute.select("id", "name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    placed = with_metres(points)
    centres = placed.filter("id % 400 = 0").selectExpr("id AS centre", "x AS cx", "y AS cy")
    near = join_within(placed, centres, 5000.0).select("id", "centre")
    slow = placed.join(centres, F.expr("(x-cx)*(x-cx) + (y-cy)*(y-cy) <= 25000000")).select("id", "centre")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, slow.collect()))


def outline(seed: int, edges: int, lon: float, lat: float, wide: float) -> list[tuple[float, float]]:
    """A closed ring around a place: a star with a ragged edge, seen from its middle."""
    own = random.Random(seed)
    turns = [2 * math.pi * i / edges for i in range(edges)]
    ring = [(lon + r * math.cos(t), lat + 0.7 * r * math.sin(t)) for t in turns for r in [wide * own.uniform(0.55, 1.0)]]
    return [*ring, ring[0]]


def comb(teeth: int, lon: float, lat: float, wide: float) -> list[tuple[float, float]]:
    """A ring of tall narrow teeth: every row of cells meets nearly all of its edges."""
    step = wide / teeth
    upper = [(lon + i * step / 2, lat + (wide if i % 2 else 0.1 * wide)) for i in range(2 * teeth + 1)]
    return [(lon, lat), (lon + wide, lat), *reversed(upper), (lon, lat)]


def test_containment_by_cells_equals_brute_force(spark):
    """Outlines of 4 to 3,000 edges with holes, corners on cell borders, points on corners and edges."""
    own = random.Random(11)
    square = [(-72.0, 45.0), (-71.0, 45.0), (-71.0, 46.0), (-72.0, 46.0), (-72.0, 45.0)]
    hole = [(-71.75, 45.25), (-71.5, 45.25), (-71.5, 45.5), (-71.75, 45.5), (-71.75, 45.25)]
    rings = {
        "square": [square, hole], "small": [outline(1, 12, -71.6, 45.4, 0.003)], "ragged": [outline(2, 3000, -71.4, 45.6, 0.8)],
        "wide": [outline(3, 400, -71.5, 45.5, 9.0)], "comb": [comb(300, -71.9, 45.1, 0.7)], "thin": [outline(4, 60, -71.2, 45.2, 0.1)]}
    polygons = spark.createDataFrame(
        [(k, [[{"lon": x, "lat": y} for x, y in ring] for ring in v]) for k, v in rings.items()],
        "name string, r array<array<struct<lon: double, lat: double>>>")
    places = [(own.uniform(-72.3, -70.7), own.uniform(44.7, 46.3)) for _ in range(2500)]
    places += [(-71.6 + own.uniform(-0.004, 0.004), 45.4 + own.uniform(-0.004, 0.004)) for _ in range(200)]
    places += [p for v in rings.values() for ring in v for p in ring[:40]]
    places += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for ring in (square, hole) for a, b in zip(ring, ring[1:])]
    places += [(-72 + i / 4, 45 + j / 4) for i in range(5) for j in range(5)] + [(None, 45.0), (-71.0, None)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, lon double, lat double")
    got = {tuple(r) for r in join_containing(points, polygons, "r").select("id", "name").collect()}
    brute = points.crossJoin(polygons.selectExpr("name", f"{ring_edges('r')} AS e")).where(contains_point("e", "lon", "lat"))
    assert got == {tuple(r) for r in brute.select("id", "name").collect()} and len(got) > 2000
    cells = polygon_cells(polygons, "r").groupBy("name").agg(
        F.max(F.size("_edges")).alias("most"), F.count_if(F.col("_edges").isNull()).alias("inner")).collect()
    most = {r.name: r.most for r in cells}
    assert most["ragged"] < 600 and most["wide"] < 200 and {r.name: r.inner for r in cells}["square"] > 4


def test_containment_without_rows(spark):
    polygons = spark.createDataFrame([("none", None), ("empty", [])], "name string, r array<array<struct<lon: double, lat: double>>>")
    points = spark.createDataFrame([(1, -71.0, 45.0)], "id int, lon double, lat double")
    assert join_containing(points, polygons, "r").count() == 0
    assert join_containing(points.where("false"), polygons, "r").count() == 0
