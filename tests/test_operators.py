import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from feederlake.operators.access import Caller, access_table, masked_text, merge_access, row_filter, with_comments
from feederlake.operators.corridor import corridor_area, corridor_blocks, corridor_ring
from feederlake.operators.features import to_features, wkt_to_geojson
from feederlake.operators.hulls import convex_hull, hull_rings, outer_points, widen
from feederlake.operators.latest import latest_record
from feederlake.operators.quality import DROP, FAIL, WARN, Rule, count_violations, enforce
from feederlake.operators.ranks import average_precision, global_percent_rank, percent_ranks, roc_auc
from feederlake.operators.running import running_sum
from feederlake.operators.snapshot import classify


# ---------------------------------------------------------------- rows

def test_latest_record_later_file_wins_and_ties_go_to_the_file_name(spark):
    rows = [("a", 1, 1, "f1"), ("a", 2, 2, "f1"), ("b", 3, 1, "f1"), ("b", 4, 1, "f2")]
    df = spark.createDataFrame(rows, "k string, v int, _ingested_at int, _source_file string")
    got = {r.k: r.v for r in latest_record(df, ["k"]).collect()}
    assert got == {"a": 2, "b": 4}


def test_latest_record_cuts_copies_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("_ingested_at"), F.lit("f").alias("_source_file"))
    plan = latest_record(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rules_fail_drop_and_warn(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, 0)], "id int, v int")
    rules = [Rule("positive", "v > 0", DROP), Rule("small", "v < 3", WARN)]
    seen = Observation()
    kept = enforce(df, rules, seen).collect()
    assert [r.id for r in kept] == [1]
    assert seen.get == {"rows": 4, "positive": 3, "small": 2}
    counted = {r.rule: r.violations for r in count_violations(df, rules).collect()}
    assert counted == {"positive": 3, "small": 2}
    with pytest.raises(Exception, match="data-quality rule positive failed"):
        enforce(df, [Rule("positive", "v > 0", FAIL)]).collect()


def test_running_sum_equals_the_window_across_chunks_and_with_equal_positions(spark):
    random.seed(5)
    rows = [(g, random.randint(1, 60), float(random.randint(1, 9))) for g in "ab" for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, pos int, v double")
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("pos")))
    got = running_sum(df, "g", "pos", "v", "s", chunk=7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("values", [
    [1.0], [2.0, 2.0], [None, 1.0, 1.0, 3.0, None], [float(v % 37) for v in range(300)],
])
def test_global_percent_rank_equals_the_window(spark, values, descending):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    order = F.col("v").desc() if descending else F.col("v").asc()
    want = df.withColumn("r", F.percent_rank().over(Window.orderBy(order)))
    got = global_percent_rank(df, "v", "r", descending, buckets=8)
    assert sorted((r.id, r.r) for r in got.collect()) == sorted((r.id, r.r) for r in want.collect())


def test_average_precision_equals_brute_force(spark):
    random.seed(7)
    rows = [(random.randint(0, 20) / 20, int(random.random() < 0.4)) for _ in range(200)]
    got = average_precision(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0]
    positives, want, before = sum(y for _, y in rows), 0.0, 0.0
    for cut in sorted({s for s, _ in rows}, reverse=True):
        taken = [y for s, y in rows if s >= cut]
        recall = sum(taken) / positives
        want += (recall - before) * sum(taken) / len(taken)
        before = recall
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- hulls and corridors

points = st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=40)


def _area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2


@settings(max_examples=60, deadline=None)
@given(points)
def test_hull_holds_every_point_and_is_its_own_hull(raw):
    pts = np.array(raw, dtype=float)
    hull = convex_hull(pts)
    assert np.array_equal(convex_hull(hull), np.unique(hull, axis=0)) or len(hull) == len(convex_hull(hull))
    if len(hull) > 2:
        closed = np.vstack([hull, hull[:1]])
        for a, b in zip(closed, closed[1:]):
            side = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
            assert (side >= 0).all()


@settings(max_examples=60, deadline=None)
@given(points)
def test_widened_ring_has_the_area_of_the_sum_of_both_shapes(raw):
    """Sum of convex shapes, found the slow way: hull of every vertex plus every circle point."""
    hull = convex_hull(np.array(raw, dtype=float))
    angles = 2 * np.pi * np.arange(32) / 32
    circle = 30 * np.column_stack([np.cos(angles), np.sin(angles)])
    slow = convex_hull((hull[:, None, :] + circle[None, :, :]).reshape(-1, 2))
    ring = widen(hull, 30.0)
    assert np.allclose(ring[0], ring[-1])
    assert _area(ring) == pytest.approx(_area(np.vstack([slow, slow[:1]])), rel=1e-9)


def test_hull_job_equals_plain_hull_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x), float(y)) for x, y in rng.normal(size=(3000, 2)) * 100]
    rows += [(f"g{i % 40}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    rows += [("single", 5.0, 5.0), ("line", 0.0, 0.0), ("line", 4.0, 0.0), ("line", 9.0, 0.0)]
    df = spark.createDataFrame(rows, "zone string, x double, y double").repartition(6)
    got = {r.zone: np.array([[p.x, p.y] for p in r.ring]) for r in hull_rings(df, "zone", 30.0).collect()}
    for name in {r[0] for r in rows}:
        want = widen(convex_hull(np.array([r[1:] for r in rows if r[0] == name])), 30.0)
        assert _area(got[name]) == pytest.approx(_area(want), rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(points, min_size=1, max_size=6))
def test_points_dropped_before_the_hull_are_no_corners(groups):
    sizes = [len(g) for g in groups]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    kept = outer_points(np.array([p for g in groups for p in g], dtype=float), starts)
    for raw, first, size in zip(groups, starts, sizes):
        pts = np.array(raw, dtype=float)
        assert np.array_equal(convex_hull(pts[kept[first:first + size]]), convex_hull(pts))


def test_hardly_any_inner_point_is_walked():
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(size=(200_000, 2)) * 300 + 2e5, rng.uniform(size=(200_000, 2))])
    kept = outer_points(pts, np.array([0, 200_000]))
    assert kept[:200_000].sum() < 2_000 and kept[200_000:].sum() < 20_000
    assert np.array_equal(convex_hull(pts[:200_000][kept[:200_000]]), convex_hull(pts[:200_000]))


def test_hull_job_leaves_out_points_without_a_place(spark):
    rows = [("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", None, 1.0), ("a", 2.0, float("nan")), ("a", float("inf"), 0.0), ("b", None, None)]
    got = hull_rings(spark.createDataFrame(rows, "zone string, x double, y double"), "zone", 30.0).collect()
    assert [r.zone for r in got] == ["a"]
    assert max(p.x for p in got[0].ring) == pytest.approx(34.0)


def _capsules(spark, spans):
    return spark.createDataFrame(spans, "line string, x1 double, y1 double, x2 double, y2 double")


def test_corridor_of_one_span_is_a_rectangle_and_a_circle(spark):
    want = 2 * 15 * 100 + math.pi * 225
    spans = [("e", 0.0, 0.0, 100.0, 0.0), ("n", 3.0, 3.0, 3.0, 103.0), ("d", 700.0, -40.0, 760.0, 40.0)]
    got = {r.line: r.area_m2 for r in corridor_area(_capsules(spark, spans), "line", 15.0).collect()}
    assert all(got[k] == pytest.approx(want, rel=1e-3) for k in "end")


def test_corridor_overlaps_count_once_whatever_the_tiles(spark):
    spans = [("l", 0.0, 0.0, 90.0, 20.0), ("l", 90.0, 20.0, 160.0, -10.0), ("l", 0.0, 0.0, 90.0, 20.0),
             ("l", 40.0, -50.0, 60.0, 60.0)]
    areas = [corridor_area(_capsules(spark, spans), "line", 15.0, tile=t).first().area_m2 for t in (16.0, 512.0)]
    assert areas[0] == pytest.approx(areas[1], rel=1e-9)

    def inside(px, py):
        hit = np.zeros(len(px), bool)
        for _, x1, y1, x2, y2 in spans:
            t = np.clip(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
            hit |= (px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2 <= 225
        return hit

    gx, gy = np.meshgrid(np.arange(-20, 180, 0.25), np.arange(-70, 80, 0.25))
    assert areas[0] == pytest.approx(inside(gx.ravel(), gy.ravel()).sum() * 0.0625, rel=3e-3)


def test_corridor_of_a_dense_tile_spreads_over_tasks(spark):
    rng = np.random.default_rng(5)
    starts = rng.uniform(0, 500, size=(100_000, 2))
    ends = starts + rng.normal(size=(100_000, 2)) * 3
    rows = [("hot", *map(float, (*a, *b))) for a, b in zip(starts, ends)] + [("cold", 0.0, 0.0, 30.0, 5.0)]
    spans = _capsules(spark, rows).repartition(8)
    dealt = corridor_blocks(spans, "line", 15.0).filter("line = 'hot' AND tx = 0 AND ty = 0")
    blocks = {(r.bx, r.by): r["count"] for r in dealt.groupBy("bx", "by").count().collect()}
    assert len(blocks) >= 50 and max(blocks.values()) < 20_000
    assert dealt.select(F.spark_partition_id()).distinct().count() == 4  # all tasks of the test's session


@pytest.mark.parametrize("crossings", [1, 7, 300, 5_000])
def test_corridor_does_not_depend_on_its_blocks(spark, crossings):
    rng = np.random.default_rng(6)
    starts = rng.uniform(-60, 200, size=(150, 2))
    rows = [("a" if i % 3 else "b", *map(float, (*p, *(p + rng.normal(size=2) * 25)))) for i, p in enumerate(starts)]
    spans = _capsules(spark, rows + rows[:20])
    whole = {r.line: r.area_m2 for r in corridor_area(_capsules(spark, rows), "line", 15.0, crossings=1 << 40).collect()}
    got = {r.line: r.area_m2 for r in corridor_area(spans, "line", 15.0, tile=96.0, crossings=crossings).collect()}
    assert got == pytest.approx(whole, rel=1e-9)


def test_corridor_of_odd_spans(spark):
    rows = [("dot", 5.0, 5.0, 5.0, 5.0), ("dot", 5.0, 5.0, 5.0, 5.0), ("half", 1.0, None, 2.0, 2.0)]
    got = {r.line: r.area_m2 for r in corridor_area(_capsules(spark, rows), "line", 15.0).collect()}
    assert got == {"dot": pytest.approx(math.pi * 225, rel=1e-3)}
    assert corridor_area(_capsules(spark, rows).limit(0), "line", 15.0).count() == 0


def test_corridor_outline_encloses_the_corridor(spark):
    ring = (_capsules(spark, [("d", 0.0, 0.0, 60.0, 80.0)])
            .selectExpr(f"{corridor_ring(15.0)} AS ring").first().ring)
    pts = np.array([[p.x, p.y] for p in ring])
    assert np.allclose(pts[0], pts[-1]) and len(pts) == 35
    assert _area(pts) == pytest.approx(3000 + math.pi * 225, rel=3e-3)


# ---------------------------------------------------------------- snapshots

def test_snapshot_operations_and_schema_growth(spark):
    old = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "x", 10), (3, "c", None, 10)],
                                "id int, v string, gone string, at int")
    new = spark.createDataFrame([(1, "a", 11, None), (2, "B", 11, None), (4, "d", 11, 5.0)],
                                "id int, v string, at int, extra double")
    rows = {r.id: r for r in classify(old, new, "id", ["at"]).withColumn(
        "id", F.col("id")).collect()}
    assert {k: r._op for k, r in rows.items()} == {1: "S", 2: "U", 3: "D", 4: "I"}
    assert rows[1].at == 10 and rows[2].at == 11  # a time stamp alone is no update
    assert rows[2].gone == "x" and rows[4].extra == 5.0 and rows[3].v == "c"


# ---------------------------------------------------------------- governance

@pytest.mark.parametrize("groups,principal,seen", [
    ((), "nobody", set()), (("admins",), "x", {"A", "B"}), (("ops_a",), "x", {"A"}),
    ((), "boss", {"A", "B"}), (("ops_a", "ops_b"), "x", {"A", "B"}),
])
def test_row_filter(spark, groups, principal, seen):
    access = access_table(spark, [("ops_a", "A"), ("ops_b", "B"), ("boss", "*")])
    df = spark.createDataFrame([("A", 1), ("B", 2)], "ced_code string, v int")
    got = row_filter(df, Caller(principal, frozenset(groups)), access)
    assert {r.ced_code for r in got.collect()} == seen


def test_text_mask_covers_null_and_access_merge_only_inserts(spark):
    df = spark.createDataFrame([("Ann",), (None,)], "name string")
    shown = df.select(masked_text(F.col("name"), Caller("x")).alias("n")).collect()
    assert {r.n for r in shown} == {"*** masqué / masked ***"}
    assert df.select(masked_text(F.col("name"), Caller("x", frozenset({"pii_readers"}))).alias("n")).first().n == "Ann"
    current = access_table(spark, [("a", "A")])
    merged = merge_access(current, access_table(spark, [("a", "A"), ("a", "B"), ("a", "B")]))
    assert sorted(tuple(r) for r in merged.collect()) == [("a", "A"), ("a", "B")]
    assert with_comments(df, {"name": "nom / name"}).schema["name"].metadata["comment"] == "nom / name"


# ---------------------------------------------------------------- features

@pytest.mark.parametrize("wkt,want", [
    ("POINT (1 2)", '{"type":"Point","coordinates":[1,2]}'),
    ("SRID=4326;POINT Z (1 2 3)", '{"type":"Point","coordinates":[1,2]}'),
    ("linestring(1 2, 3.5 -4)", '{"type":"LineString","coordinates":[[1,2],[3.5,-4]]}'),
    ("POLYGON ((0 0, 1 0, 1 1, 0 0), (.1 .1, .2 .1, .2 .2, .1 .1))",
     '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.1,0.1],[0.2,0.1],[0.2,0.2],[0.1,0.1]]]}'),
    ("POINT (+1 -.5)", '{"type":"Point","coordinates":[1,-0.5]}'),
    ("LINESTRING (1. 2.50, 007 1e3)", '{"type":"LineString","coordinates":[[1,2.50],[7,1e3]]}'),
    ("MULTIPOINT ((1 2), (3 4))", '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}'),
    ("MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))",
     '{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[5,6],[7,8]]]}'),
    ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
     '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'),
    ("CIRCLE (1 2)", None), ("nonsense", None),
])
def test_wkt_to_geojson(spark, wkt, want):
    assert spark.createDataFrame([(wkt,)], "w string").select(wkt_to_geojson(F.col("w"))).first()[0] == want


def test_broken_geometry_is_left_out(spark):
    rows = [("a", "{broken"), ("b", "POINT (+1 .5)"), ("c", '{"type":"Point","coordinates":[1,2]}'), ("d", "POINT (1 x)")]
    found = [json.loads(r.feature) for r in to_features(spark.createDataFrame(rows, "id string, geojson string")).collect()]
    assert sorted(f["properties"]["id"] for f in found) == ["b", "c"]


def test_features_use_a_geometry_first_and_coordinates_otherwise(spark):
    df = spark.createDataFrame(
        [("a", '{"type":"Point","coordinates":[9,9]}', 1.0, 2.0), ("b", None, 3.0, 4.0), ("c", None, None, 4.0)],
        "id string, geojson string, lon double, lat double")
    got = [r.feature for r in to_features(df).collect()]
    assert got == [
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[9,9]},'
        '"properties":{"id":"a","lon":1.0,"lat":2.0}}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[3.0,4.0]},'
        '"properties":{"id":"b","lon":3.0,"lat":4.0}}']


def test_percent_ranks_of_several_columns_in_one_pass(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else i % 3, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b int, c int")
    got = percent_ranks(df, "k", ["a", "b", "c"])
    want = df.select("k", *[F.percent_rank().over(Window.orderBy(c)).alias(f"rank_{i}") for i, c in enumerate("abc")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_roc_auc_is_exact_beyond_a_thousand_scores(spark):
    rows = [((i * 7919) % 5000 / 5000, int((i * 31) % 100 < (i * 7919) % 5000 / 50)) for i in range(5000)] + [(0.5, 1), (0.5, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    ups, downs = [s for s, y in rows if y], sorted(s for s, y in rows if not y)
    from bisect import bisect_left, bisect_right
    wins = sum(bisect_left(downs, s) + (bisect_right(downs, s) - bisect_left(downs, s)) / 2 for s in ups)
    assert abs(roc_auc(df, "s", "y").first()[0] - wins / (len(ups) * len(downs))) < 1e-12
    assert roc_auc(df.filter("y = 1"), "s", "y").first()[0] is None
