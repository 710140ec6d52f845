"""Every registered query with its DuckDB counterpart, side by side."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederlake.checks import oracle as o
from feederlake.checks.landed import landed_twice
from feederlake.functions import shapes
from feederlake.operators.access import Caller
from feederlake.operators.features import to_features
from feederlake.operators.latest import latest_record
from feederlake.operators.quality import count_violations
from feederlake.operators.snapshot import KeyedTable, changes
from feederlake.plans import layers, ops, questions, risk
from feederlake.plans import gold as _gold  # noqa: F401
from feederlake.plans.network import Network, Settings
from feederlake.plans.secured import SecuredView
from feederlake.plans.silver import rules_for, unchecked
from feederlake.schemas import EXTRACTS
from feederlake.session import scratch_path, settle, tune
from feederlake.sources.mapped import AS_OF, FEATURE_WINTER, LABEL_WINTER, MappedTables
from feederlake.sources.tables import TableStore
from feederlake.streaming.ingest import Landing
from feederlake.streaming.sync import Mirror

# parameters of the questions
REGION = "AMERICA"
CENTRE = "C1"
SUBSTATION = "POSTE NATION_16"
LINE = "Supplier#000000003"
DEVICE = "Supplier#000000002_F1"
SELECTION = [(-74.0035, 54.4975), (-73.9960, 54.4968), (-73.9925, 54.5012), (-73.9963, 54.5051),
             (-74.0030, 54.5047), (-74.0061, 54.5008), (-74.0035, 54.4975)]
SELECTION_JSON = ('{"type":"Polygon","coordinates":[['
                  + ",".join(f"[{a},{b}]" for a, b in SELECTION) + "]]}")
MASKED_CALLER = Caller("operator", frozenset({"all_centres"}))
PII_CALLER = Caller("auditor", frozenset({"all_centres", "pii_readers"}))
LOCAL_CALLER = Caller("dispatcher", frozenset({"ops_AMERICA"}))


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None, landed: bool = True):
    def register(fn):
        CHECKS[name] = Check(fn, o.sql(sql, landed) if sql else None)
        return fn

    return register


# ---------------------------------------------------------------- contexts

def network(spark: SparkSession, folder: str, landed: bool = True) -> Network:
    tables = MappedTables(tune(spark), folder)
    settings = Settings(AS_OF, FEATURE_WINTER, LABEL_WINTER)
    extract = landed_twice(tables) if landed else tables.entity
    return Network(spark, extract, settings, relanded=landed, scorer=risk.last_winter_scorer)


def access(net: Network) -> DataFrame:
    """One group per region, and one for all of them."""
    centres = net.table("silver.operating_centers")
    return centres.select(F.concat(F.lit("ops_"), "region_name").alias("principal"), "ced_code").unionByName(
        centres.select(F.lit("all_centres").alias("principal"), F.lit("*").alias("ced_code")).distinct())


def view(spark: SparkSession, folder: str, caller: Caller = MASKED_CALLER) -> SecuredView:
    net = network(spark, folder)
    return SecuredView(net, caller, access(net))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _r(digits: int, *columns: str) -> str:
    return ", ".join(f"{o.rnd(c, digits)} AS {c}" for c in columns)


# ---------------------------------------------------------------- operators

@check("latest_event_per_user", """SELECT * FROM events QUALIFY row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event_per_user(spark, folder):
    events = tune(spark).read.parquet(f"{folder}/events.parquet")
    return latest_record(events, ["user_id"], ["ts", "event_id"])


_RULE_SQL = {
    # the centres' rings are boxes: one that is not turned inside out has no edges that cross
    ("operating_centers", "valid_polygon", "fail"): ("x_ced", "west < east AND south < north"),
    ("substations", "valid_coords", "drop"): ("x_substations", "lon BETWEEN -80 AND -57 AND lat BETWEEN 44 AND 63"),
    ("poles", "valid_coords", "drop"): ("u_poles", "lon BETWEEN -80 AND -57 AND lat BETWEEN 44 AND 63"),
    ("poles", "plausible_install_year", "warn"): ("u_poles", "install_year BETWEEN 1940 AND 2001"),
    ("spans", "positive_length", "drop"): ("u_spans", "length_m > 0"),
    ("transformers", "has_pole", "drop"): ("u_transformers", "pole_id IS NOT NULL"),
    ("transformers", "valid_kva", "warn"): ("u_transformers", "kva > 0"),
    ("protection_devices", "valid_coords", "drop"): ("x_protection_devices",
                                                     "lon BETWEEN -80 AND -57 AND lat BETWEEN 44 AND 63"),
    ("customers", "valid_coords", "drop"): ("x_customers", "lon BETWEEN -80 AND -57 AND lat BETWEEN 44 AND 63"),
    ("customers", "has_transformer", "drop"): ("x_customers", "transformer_id IS NOT NULL"),
    ("outages", "valid_customers", "drop"): ("u_outages", "customers_interrupted > 0"),
    ("outages", "end_after_start", "warn"): ("u_outages", "end_ts IS NULL OR end_ts >= start_ts"),
    ("transformer_load_daily", "positive_peak", "drop"): ("u_load", "peak_kva >= 0"),
}


@check("quality_violations", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{r}' AS rule, '{a}' AS action, "
    f"count(*) FILTER (NOT coalesce({cond}, false)) AS violations FROM {step}"
    for (t, r, a), (step, cond) in _RULE_SQL.items()), landed=True)
def quality_violations(spark, folder):
    net = network(spark, folder, landed=True)
    rules = rules_for(net)
    parts = [count_violations(unchecked(net, t), rules[t]).select(F.lit(t).alias("table_name"), "*")
             for t in dict.fromkeys(t for t, _, _ in _RULE_SQL)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---------------------------------------------------------------- silver, from extracts landed twice

def _silver(name: str, sql: str, fix: Callable[[DataFrame], DataFrame] = lambda df: df):
    @check(f"silver_{name}", sql, landed=True)
    def run(spark, folder):
        return fix(network(spark, folder, landed=True).table(f"silver.{name}"))


_silver("operating_centers", f"""SELECT ced_code, ced_name, region_name, is_urban,
  'POLYGON ((' || {o.num('west')} || ' ' || {o.num('south')} || ', ' || {o.num('east')} || ' ' || {o.num('south')} || ', '
  || {o.num('east')} || ' ' || {o.num('north')} || ', ' || {o.num('west')} || ' ' || {o.num('north')} || ', '
  || {o.num('west')} || ' ' || {o.num('south')} || '))' AS wkt FROM s_ced""",
        lambda df: df.select("ced_code", "ced_name", "region_name", "is_urban",
                             F.expr(shapes.polygon_wkt("rings")).alias("wkt")))
_silver("substations", f"""SELECT substation_code, substation_name, ced_code, capacity_mva, {_r(7, 'lon', 'lat')},
  {_r(3, 'x', 'y')} FROM s_substations""", lambda df: rounded(rounded(df, 7, "lon", "lat"), 3, "x", "y"))
_silver("lines", """SELECT line_id, substation_code, ced_code, voltage_kv, commissioning_year, conductor
  FROM s_lines""")
_silver("poles", f"""SELECT pole_id, line_id, branch_id, branch_seq, parent_pole_id, install_year, age_years, material,
  height_m, {_r(7, 'lon', 'lat')}, {_r(3, 'x', 'y')}, {o.hexcell('x', 'y', 9)} AS hex_cell_9 FROM s_poles""",
        lambda df: rounded(rounded(df, 7, "lon", "lat"), 3, "x", "y"))
_silver("spans", f"""SELECT span_id, line_id, branch_id, branch_seq, from_node_id, to_pole_id,
  {o.linestring('lon1', 'lat1', 'lon2', 'lat2')} AS geojson, {_r(3, 'length_m')} FROM s_spans""",
        lambda df: rounded(df, 3, "length_m").select(
            "span_id", "line_id", "branch_id", "branch_seq", "from_node_id", "to_pole_id",
            F.expr(shapes.line_geojson()).alias("geojson"), "length_m"))
_silver("transformers", f"""SELECT transformer_id, pole_id, line_id, branch_id, kva, install_year, age_years, phase,
  manufacturer, {_r(7, 'lon', 'lat')}, {o.hexcell('x', 'y', 9)} AS hex_cell_9 FROM s_transformers""",
        lambda df: rounded(df, 7, "lon", "lat").drop("x", "y"))
_silver("protection_devices", f"""SELECT device_id, device_type, line_id, protected_branch_id, pole_id, rating_a,
  install_year, {_r(7, 'lon', 'lat')} FROM s_devices""", lambda df: rounded(df, 7, "lon", "lat"))
_silver("customers", f"""SELECT customer_id, transformer_id, customer_name, address, municipality, customer_type,
  electric_heating, contract_kw, {_r(7, 'lon', 'lat')}, hex_cell_8 FROM s_customers""",
        lambda df: rounded(df, 7, "lon", "lat").drop("x", "y"))
_silver("outages", """SELECT outage_id, device_id, start_ts, end_ts, is_ongoing, cause, customers_interrupted,
  duration_h, fault_lon, fault_lat FROM s_outages""")
_silver("weather_daily", "SELECT weather_date, ced_code, temp_min_c, temp_max_c FROM s_weather")
_silver("transformer_load_daily", """SELECT transformer_id, line_id, reading_date, peak_kva, energy_kwh, overload_pct,
  winter_label FROM s_load""")


# ---------------------------------------------------------------- gold

def _gold_check(name: str, sql: str, fix: Callable[[DataFrame], DataFrame] = lambda df: df, key: str | None = None):
    @check(key or f"gold_{name}", sql)
    def run(spark, folder):
        return fix(network(spark, folder).table(f"gold.{name}"))


def _ring_area(corners: str) -> str:
    return (f"(SELECT abs(sum(x*ny - nx*y))/2 FROM (SELECT x, y, lead(x) OVER (ORDER BY i) AS nx, "
            f"lead(y) OVER (ORDER BY i) AS ny FROM ({corners})))")


_RECT = "".join(
    f" UNION ALL SELECT ced_code, {i} AS i, {lon} AS lon, {lat} AS lat FROM s_ced"
    for i, (lon, lat) in enumerate([("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"),
                                    ("west", "south")]))[len(" UNION ALL "):]
_gold_check("operating_centers", f"""SELECT c.ced_code, c.ced_name, c.region_name, c.is_urban, {o.rnd('a.area', 3)}
  AS area_km2 FROM s_ced c JOIN (SELECT ced_code, abs(sum(x*ny - nx*y))/2e6::DOUBLE AS area FROM (
    SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (
      SELECT ced_code, i, {o.x_m('lon', 'lat')} AS x, {o.y_m('lon', 'lat')} AS y FROM ({_RECT}))
    WINDOW w AS (PARTITION BY ced_code ORDER BY i)) GROUP BY 1) a USING (ced_code)""",
            lambda df: rounded(df, 3, "area_km2").drop("rings"))
_gold_check("substations", f"""SELECT substation_code, substation_name, s.ced_code, region_name, capacity_mva,
  {o.point('lon', 'lat')} AS geojson FROM s_substations s JOIN s_ced c ON s.ced_code = c.ced_code""",
            lambda df: df.select("substation_code", "substation_name", "ced_code", "region_name", "capacity_mva",
                                 F.expr(shapes.point_geojson()).alias("geojson")))
_gold_check("poles", f"""SELECT pole_id, line_id, substation_code, substation_name, ced_code, region_name, branch_id,
  branch_type, branch_seq, parent_pole_id, install_year, age_years, material, height_m,
  {_r(3, 'distance_to_substation_m', 'network_distance_m')}, {_r(7, 'lon', 'lat')}, {o.hexcell('x', 'y', 9)} AS hex_cell_9
  FROM g_poles""",
            lambda df: rounded(rounded(df, 3, "distance_to_substation_m", "network_distance_m"), 7, "lon", "lat")
            .drop("x", "y", "sub_x", "sub_y"))
_gold_check("spans", f"""SELECT span_id, line_id, substation_code, ced_code, region_name, branch_id, from_node_id,
  to_pole_id, {o.rnd('length_m', 1)} AS length_m, {_r(7, 'lon1', 'lat1', 'lon2', 'lat2')}
  FROM s_spans JOIN line_regions USING (line_id)""",
            lambda df: rounded(df, 7, "lon1", "lat1", "lon2", "lat2").drop("x1", "y1", "x2", "y2"))
_gold_check("protection_devices", f"SELECT * REPLACE ({_r(7, 'lon', 'lat')}) FROM g_devices",
            lambda df: rounded(df, 7, "lon", "lat"))
_gold_check("customers_pii", f"""SELECT * REPLACE ({_r(3, 'distance_to_substation_m', 'network_distance_m')},
            {_r(7, 'lon', 'lat')}) FROM g_customers""",
            lambda df: rounded(rounded(df, 3, "distance_to_substation_m", "network_distance_m"), 7, "lon", "lat")
            .drop("x", "y"))
_gold_check("line_areas", f"SELECT line_id, {o.rnd('area_m2', 2)} AS area_m2 FROM line_areas",
            lambda df: rounded(df, 2, "area_m2"), key="right_of_way_area")
_gold_check("lines", "SELECT * FROM g_lines")
_gold_check("transformers", f"SELECT * REPLACE ({_r(3, 'distance_to_substation_m')}, {_r(7, 'lon', 'lat')}) "
                            "FROM g_transformers",
            lambda df: rounded(rounded(df, 3, "distance_to_substation_m"), 7, "lon", "lat").drop("hex_cell_9"))
_gold_check("transformer_load_daily", "SELECT * FROM g_load")
_gold_check("outages", "SELECT * FROM g_outages")
_gold_check("zone_summary", "SELECT * FROM zones")

# the outline as the SQL side builds it: hull edges and circle edges laid end to end by direction
_N = 32
o.STEPS["zone_edges"] = f"""SELECT zone_id, qx-px AS dx, qy-py AS dy, 0 AS circle FROM hull_edges UNION ALL
  SELECT zone_id, 30*(cos(2*pi()*(k+1)/{_N}) - cos(2*pi()*k/{_N})), 30*(sin(2*pi()*(k+1)/{_N}) - sin(2*pi()*k/{_N})), 1
  FROM (SELECT DISTINCT zone_id FROM hull_edges), (SELECT unnest(range({_N})) AS k)"""
o.STEPS["zone_ring"] = f"""SELECT zone_id, i, sx + coalesce(px, 0) AS x, sy + coalesce(py, 0) AS y FROM (
    SELECT zone_id, 0 AS i, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py FROM hull_edges GROUP BY 1 UNION ALL
    SELECT zone_id, row_number() OVER w, sum(dx) OVER w, sum(dy) OVER w FROM
      (SELECT *, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2*pi() ELSE atan2(dy, dx) END AS turn FROM zone_edges)
    WINDOW w AS (PARTITION BY zone_id ORDER BY turn, circle ROWS UNBOUNDED PRECEDING))
  JOIN (SELECT zone_id, px + 30*cos(2*pi()*24/{_N}) AS sx, py + 30*sin(2*pi()*24/{_N}) AS sy FROM hull_edges
        QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY py, px) = 1) USING (zone_id)"""
o.STEPS["zone_ring_deg"] = f"""SELECT zone_id, i, {o.lon_deg('x', 'y')} AS lon, {o.lat_deg('x', 'y')} AS lat
  FROM zone_ring"""
o.STEPS["zone_text"] = f"""SELECT zone_id, '{{"type":"Polygon","coordinates":[[' || string_agg('[' || {o.num('lon')} || ','
  || {o.num('lat')} || ']', ',' ORDER BY i) || ']]}}' AS geojson FROM zone_ring_deg GROUP BY 1"""
o.STEPS["zone_centres"] = """SELECT zone_id, any_value(ox) + sum((x+nx)*(x*ny-nx*y))/(3*sum(x*ny-nx*y)) AS centroid_lon,
  any_value(oy) + sum((y+ny)*(x*ny-nx*y))/(3*sum(x*ny-nx*y)) AS centroid_lat FROM (
    SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (
      SELECT zone_id, i, ox, oy, lon-ox AS x, lat-oy AS y FROM zone_ring_deg
      JOIN (SELECT zone_id, lon AS ox, lat AS oy FROM zone_ring_deg WHERE i = 0) USING (zone_id))
    WINDOW w AS (PARTITION BY zone_id ORDER BY i)) GROUP BY 1"""
o.STEPS["paths"] = f"""SELECT line_id, branch_id || '#' || ((branch_seq - 1) // 1000) AS part, '{{"type":"MultiLineString","coordinates":[' || string_agg('[[' || {o.num('lon1')} ||
  ',' || {o.num('lat1')} || '],[' || {o.num('lon2')} || ',' || {o.num('lat2')} || ']]', ','
  ORDER BY branch_id, branch_seq, span_id) || ']}}' AS geojson FROM s_spans GROUP BY 1, 2"""
o.STEPS["outline_points"] = f"""SELECT line_id, branch_id, branch_seq, span_id, k, {o.lon_deg('px', 'py')} AS lon,
  {o.lat_deg('px', 'py')} AS lat FROM (SELECT *,
    CASE WHEN k % 34 <= 16 THEN x2 ELSE x1 END + CASE WHEN k % 34 <= 16 THEN 1 ELSE -1 END*15*
      (ux*cos(pi()/2*((k%17)/8.0::DOUBLE-1)) - uy*sin(pi()/2*((k%17)/8.0::DOUBLE-1))) AS px,
    CASE WHEN k % 34 <= 16 THEN y2 ELSE y1 END + CASE WHEN k % 34 <= 16 THEN 1 ELSE -1 END*15*
      (ux*sin(pi()/2*((k%17)/8.0::DOUBLE-1)) + uy*cos(pi()/2*((k%17)/8.0::DOUBLE-1))) AS py
    FROM (SELECT *, (x2-x1)/length_m AS ux, (y2-y1)/length_m AS uy FROM s_spans), (SELECT unnest(range(35)) AS k))"""
o.STEPS["outlines"] = f"""SELECT line_id, branch_id || '#' || ((branch_seq - 1) // 1000) AS part, '{{"type":"MultiPolygon","coordinates":[' || string_agg('[[' || ring || ']]', ','
  ORDER BY branch_id, branch_seq, span_id) || ']}}' AS geojson FROM (SELECT line_id, branch_id, branch_seq, span_id,
    string_agg('[' || {o.num('lon')} || ',' || {o.num('lat')} || ']', ',' ORDER BY k) AS ring FROM outline_points
    GROUP BY ALL) GROUP BY 1, 2"""
_corners = ", ".join(
    f"[{o.EDGE_M[8] * math.cos(math.pi / 6 + k * math.pi / 3)!r}::DOUBLE, "
    f"{o.EDGE_M[8] * math.sin(math.pi / 6 + k * math.pi / 3)!r}::DOUBLE]" for k in (0, 1, 2, 3, 4, 5, 0))
o.STEPS["hex_text"] = f"""SELECT hex_cell_8, '{{"type":"Polygon","coordinates":[[' || string_agg('[' ||
  {o.num(o.lon_deg('hx', 'hy'))} || ',' || {o.num(o.lat_deg('hx', 'hy'))} || ']', ',' ORDER BY k) || ']]}}' AS geojson
  FROM (SELECT hex_cell_8, k, cx + corners[k][1] AS hx, cy + corners[k][2] AS hy FROM (SELECT hex_cell_8, cx, cy,
    unnest(range(1, 8)) AS k, [{_corners}] AS corners FROM cell_centres)) GROUP BY 1"""
o._CHAINS.update({flag: o._chain(flag) for flag in (False, True)})

_gold_check("zone_shapes", f"""SELECT zone_id, {o.rnd('area_m2/1e6::DOUBLE', 3)} AS zone_area_km2,
  {_r(7, 'centroid_lon', 'centroid_lat')}, geojson FROM zone_areas JOIN zone_centres USING (zone_id)
  JOIN zone_text USING (zone_id)""",
            lambda df: rounded(df, 7, "centroid_lon", "centroid_lat").select(
                "zone_id", "zone_area_km2", "centroid_lon", "centroid_lat",
                F.expr(shapes.polygon_geojson("array(zone_ring)")).alias("geojson")))
_gold_check("protection_zones", f"""SELECT zones.*, {o.rnd('area_m2/1e6::DOUBLE', 3)} AS zone_area_km2,
  {_r(7, 'centroid_lon', 'centroid_lat')} FROM zones JOIN zone_areas USING (zone_id) JOIN zone_centres USING (zone_id)""",
            lambda df: rounded(df, 7, "centroid_lon", "centroid_lat").drop("zone_ring"))
_gold_check("chi_hex", "SELECT * FROM g_hex", lambda df: df.drop("cell_ring"))


@check("pole_distances_by_branch", f"""SELECT branch_id, count(*) AS poles, {o.rnd('max(network_distance_m)', 3)}
  AS farthest_m, {o.rnd('min(network_distance_m)', 3)} AS nearest_m FROM g_poles GROUP BY 1""")
def pole_distances_by_branch(spark, folder):
    return network(spark, folder).table("gold.poles").groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("poles"), F.round(F.max("network_distance_m"), 3).alias("farthest_m"),
        F.round(F.min("network_distance_m"), 3).alias("nearest_m"))


# ---------------------------------------------------------------- risk

@check("winter_features", f"SELECT * REPLACE ({_r(6, 'kva_per_degree_below_15', 'customers_per_10kva')}) "
                          "FROM features_last")
def winter_features(spark, folder):
    net = network(spark, folder)
    return rounded(risk.winter_features(net, net.settings.label_winter), 6, "kva_per_degree_below_15",
                   "customers_per_10kva")


@check("training_set", f"""SELECT f.* REPLACE ({_r(6, 'kva_per_degree_below_15', 'customers_per_10kva')}),
  l.overload_next_winter FROM features_prev f JOIN (SELECT transformer_id,
    CAST(max(overload_pct) > 150 AS INTEGER) AS overload_next_winter FROM g_load WHERE winter_label = 'Hiver {o.LABEL}'
    GROUP BY 1) l USING (transformer_id)""")
def training_set(spark, folder):
    return rounded(risk.training_set(network(spark, folder)), 6, "kva_per_degree_below_15", "customers_per_10kva")


@check("class_weights", f"""SELECT overload_next_winter, {o.rnd('sum(n) OVER ()/(2.0::DOUBLE*n)', 9)} AS weight, n AS rows FROM
  (SELECT overload_next_winter, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(max(overload_pct) > 150 AS INTEGER)
   AS overload_next_winter FROM g_load JOIN (SELECT DISTINCT transformer_id FROM features_prev) USING (transformer_id)
   WHERE winter_label = 'Hiver {o.LABEL}' GROUP BY transformer_id) GROUP BY 1)""")
def class_weights(spark, folder):
    train = settle(risk.training_set(network(spark, folder)).select("overload_next_winter"), "training")
    return risk.balanced_weights(train, "overload_next_winter").groupBy("overload_next_winter").agg(
        F.round(F.max("weight"), 9).alias("weight"), F.count(F.lit(1)).alias("rows"))


@check("baseline_transformer_risk", f"SELECT * REPLACE ({_r(9, 'risk_score')}) FROM tx_risk")
def baseline_transformer_risk(spark, folder):
    return rounded(network(spark, folder).table("gold.transformer_risk").drop("model_version"), 9, "risk_score")


BENCH_MODEL = risk.ModelSpec(rounds=10, rate=0.2)


@check("transformer_risk", """SELECT transformer_id, line_id, ced_code, target_winter, max_overload_pct_last_winter,
  days_over_150_last_winter, kva, n_customers, true AS score_in_range, true AS tier_follows_score FROM tx_risk""")
def transformer_risk(spark, folder):
    """The learned model's table: what does not depend on training, the range of the score and the rule of the tier."""
    net = network(spark, folder)
    net.scorer = risk.boosted_scorer(BENCH_MODEL)
    score = F.col("risk_score")
    tier = F.when(score > 0.6, "ÉLEVÉ").when(score > 0.3, "MOYEN").otherwise("FAIBLE")
    return net.table("gold.transformer_risk").select(
        "transformer_id", "line_id", "ced_code", "target_winter", "max_overload_pct_last_winter",
        "days_over_150_last_winter", "kva", "n_customers", score.between(0.0, 1.0).alias("score_in_range"),
        (F.col("risk_tier") == tier).alias("tier_follows_score"))


@check("holdout_baseline", f"""SELECT count(*) AS rows, {o.rnd('avg(y)', 9)} AS positive_rate,
  {o.rnd('(count(*) FILTER (max_overload_pct > 150 AND y = 1))::DOUBLE / greatest(1, sum(y))', 9)} AS baseline_last_winter_recall
  FROM (SELECT *, max(CASE WHEN before < 0.25::DOUBLE * whole THEN bucket END) OVER (PARTITION BY y) AS cut FROM (
    SELECT *, (count(*) OVER (PARTITION BY y ORDER BY bucket RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY y, bucket))
        AS before, count(*) OVER (PARTITION BY y) AS whole
    FROM (SELECT f.max_overload_pct, l.y, ('0x' || left(md5(f.transformer_id), 8))::BIGINT % 4096 AS bucket
          FROM features_prev f JOIN (SELECT transformer_id, CAST(max(overload_pct) > 150 AS INTEGER) AS y FROM g_load
            WHERE winter_label = 'Hiver {o.LABEL}' GROUP BY 1) l USING (transformer_id)))) WHERE bucket <= cut""")
def holdout_baseline(spark, folder):
    _, test = risk.hold_out(settle(risk.training_set(network(spark, folder)), "training"))
    return risk.baseline(test)


@check("zone_risk", f"""SELECT r.* EXCLUDE (n_poles, chi_24m), {_r(7, 'centroid_lon', 'centroid_lat')} FROM g_zone_risk r
  JOIN zone_centres USING (zone_id)""")
def zone_risk(spark, folder):
    return rounded(network(spark, folder).table("gold.zone_risk"), 7, "centroid_lon", "centroid_lat")


@check("advice_prompts", """SELECT zone_id, risk_score, concat_ws('. ', concat_ws('; ',
  'Zone ' || zone_id || ' (' || device_type || '), ligne ' || line_id || ', région ' || region_name,
  'clients : ' || coalesce(n_customers, 0), 'interruptions sur 6 mois : ' || interruptions_6m,
  'CHI sur 6 mois : ' || chi_6m, 'tendance CHI : ' || coalesce(chi_trend_pct, 0) || ' %',
  'âge moyen des poteaux : ' || avg_pole_age_years, 'transformateurs à risque élevé : ' || high_risk_transformers),
  'Proposer une seule mesure pour l''exploitation, en 35 mots au plus, d''abord en français, puis en anglais après « || ».')
  AS prompt FROM g_zone_risk ORDER BY risk_score DESC, zone_id LIMIT 15""")
def advice_prompts(spark, folder):
    return risk.prompts(network(spark, folder))


# ---------------------------------------------------------------- governance

@check("customers_masked", f"SELECT * REPLACE ({_r(3, 'distance_to_substation_m', 'network_distance_m')}, "
                           f"{_r(7, 'lon', 'lat')}) FROM g_customers_masked")
def customers_masked(spark, folder):
    df = view(spark, folder).table("gold.customers")
    return rounded(rounded(df.drop("x", "y"), 3, "distance_to_substation_m", "network_distance_m"), 7, "lon", "lat")


@check("customers_of_centre", "SELECT customer_id, customer_name, ced_code, zone_id FROM g_customers "
                              "WHERE region_name = 'AMERICA'")
def customers_of_centre(spark, folder):
    caller = Caller("auditor", frozenset({"ops_AMERICA", "pii_readers"}))
    return view(spark, folder, caller).table("gold.customers").select("customer_id", "customer_name", "ced_code",
                                                                      "zone_id")


@check("outages_of_centre", "SELECT * FROM g_outages WHERE region_name = 'AMERICA'")
def outages_of_centre(spark, folder):
    return view(spark, folder, LOCAL_CALLER).table("gold.outages")


# ---------------------------------------------------------------- questions

def _question(name: str, sql: str, caller: Caller = MASKED_CALLER, key: str | None = None, **parameters):
    @check(key or f"question_{name}", sql)
    def run(spark, folder):
        return questions.QUESTIONS[name](view(spark, folder, caller), **parameters)


_question("old_transformers_in_region", f"""SELECT transformer_id, line_id, substation_code, install_year, kva,
  n_customers, t.lon, t.lat, {o.point('t.lon', 't.lat')} AS geojson FROM g_transformers t JOIN s_ced c
  ON t.lon > c.west AND t.lon < c.east AND t.lat > c.south AND t.lat < c.north
  WHERE c.region_name = '{REGION}' AND install_year < 1985""", region=REGION)
_question("device_impact", f"""SELECT device_id, device_type, line_id, customers_downstream AS clients_affectes,
  transformers_downstream AS transformateurs_affectes, geojson FROM g_devices JOIN zone_text ON zone_id = device_id
  WHERE device_id = '{DEVICE}'""", device=DEVICE)
_question("line_reach", f"""SELECT line_id, {o.rnd('max(distance_to_substation_m)', 0)} AS distance_max_vol_oiseau_m,
  {o.rnd('max(network_distance_m)', 0)} AS distance_max_le_long_de_la_ligne_m FROM g_poles WHERE line_id = '{LINE}'
  GROUP BY 1""", line=LINE)
_question("most_interrupted_zones", f"""SELECT e.zone_id, device_type, line_id, region_name, n_customers,
  nb_interruptions, chi, geojson FROM (SELECT zone_id, count(*) AS nb_interruptions, {o.rnd('sum(chi)', 1)} AS chi
    FROM g_outages WHERE start_ts >= {o.months_back(3)} GROUP BY 1) e JOIN zones USING (zone_id) JOIN zone_text
  USING (zone_id) ORDER BY nb_interruptions DESC, chi DESC, zone_id LIMIT 10""")
_question("highest_chi_zones", f"""SELECT e.zone_id, device_type, line_id, region_name, n_customers,
  nb_interruptions, chi_6_mois, geojson FROM (SELECT zone_id, count(*) AS nb_interruptions,
    {o.rnd('sum(chi)', 1)} AS chi_6_mois FROM g_outages WHERE start_ts >= {o.months_back(6)} GROUP BY 1) e
  JOIN zones USING (zone_id) JOIN zone_text USING (zone_id) ORDER BY chi_6_mois DESC, zone_id LIMIT 10""")
_question("right_of_way", f"""SELECT line_id, substation_name, length_km, right_of_way_area_m2 AS emprise_m2,
  {o.rnd('area_m2/10000', 2)} AS emprise_ha FROM g_lines JOIN line_areas USING (line_id)
  WHERE substation_name = '{SUBSTATION}'""", substation=SUBSTATION)
_question("right_of_way_shapes", f"""SELECT line_id, part, geojson FROM g_lines JOIN outlines USING (line_id)
  WHERE substation_name = '{SUBSTATION}'""", substation=SUBSTATION)
_question("farthest_customers", f"""SELECT customer_id, line_id, substation_code, municipality,
  {o.rnd('distance_to_substation_m', 0)} AS distance_vol_oiseau_m, {o.rnd('network_distance_m', 0)} AS distance_reseau_m,
  {o.point('lon', 'lat')} AS geojson FROM (SELECT *, percent_rank() OVER (ORDER BY distance_to_substation_m DESC)
    AS pct FROM g_customers_masked WHERE ced_code = '{CENTRE}') WHERE pct <= 0.01::DOUBLE""", ced=CENTRE)
_question("overloaded_transformers", f"""SELECT transformer_id, t.kva, t.n_customers, surcharge_max_pct, jours_sup_150,
  premier_jour, dernier_jour, {o.point('t.lon', 't.lat')} AS geojson FROM g_transformers t JOIN (SELECT transformer_id,
    max(overload_pct) AS surcharge_max_pct, count(*) AS jours_sup_150, min(reading_date) AS premier_jour,
    max(reading_date) AS dernier_jour FROM g_load WHERE line_id = '{LINE}' AND winter_label = 'Hiver {o.FEATURE}'
    AND overload_pct > 150 GROUP BY 1) USING (transformer_id)""", line=LINE, winter=FEATURE_WINTER)
_OLDEST_POLES = f"""SELECT pole_id, install_year, age_years, material, branch_type,
  {o.rnd('network_distance_m', 0)} AS distance_reseau_m, {o.point('lon', 'lat')} AS geojson FROM g_poles
  WHERE line_id = '{LINE}' ORDER BY install_year, pole_id LIMIT 20"""
_question("oldest_poles", _OLDEST_POLES, line=LINE)
_question("longest_spans", f"""SELECT span_id, line_id, region_name, from_node_id, to_pole_id,
  {o.rnd('length_m', 1)} AS longueur_m, {o.linestring('lon1', 'lat1', 'lon2', 'lat2')} AS geojson FROM s_spans
  JOIN line_regions USING (line_id) ORDER BY longueur_m DESC, span_id LIMIT 20""")
_question("riskiest_transformers", f"""SELECT r.transformer_id, r.line_id, r.ced_code,
  {o.rnd('100.0::DOUBLE*r.risk_score', 1)} AS risque_pct, r.risk_tier, r.max_overload_pct_last_winter,
  {o.point('t.lon', 't.lat')} AS geojson FROM tx_risk r JOIN g_transformers t USING (transformer_id)
  ORDER BY r.risk_score DESC, r.transformer_id LIMIT 20""")
_question("high_risk_zones", """SELECT zone_id, line_id, region_name, risk_score, chi_6m, chi_trend_pct,
  avg_pole_age_years, high_risk_transformers, geojson FROM g_zone_risk JOIN zone_text USING (zone_id)
  WHERE risk_tier = 'ÉLEVÉ'""")
_question("ongoing_outages", f"""SELECT outage_id, zone_id, line_id, region_name, start_ts, cause,
  customers_interrupted, {o.rnd('duration_h', 1)} AS duree_h, {o.point('fault_lon', 'fault_lat')} AS geojson
  FROM g_outages WHERE is_ongoing""")
_NEAR = """SELECT count(*) AS nb_clients FROM (SELECT {x} AS px, {y} AS py FROM {customers}) JOIN s_substations s
  ON s.substation_name = '{substation}' AND (px-s.x)*(px-s.x) + (py-s.y)*(py-s.y) <= 250000"""
_question("customers_near_substation", _NEAR.format(x=o.x_m("lon", "lat"), y=o.y_m("lon", "lat"), customers="g_customers",
          substation=SUBSTATION), caller=PII_CALLER, substation=SUBSTATION)
_question("customers_near_substation", _NEAR.format(x=o.x_m("lon", "lat"), y=o.y_m("lon", "lat"),
          customers="g_customers_masked", substation=SUBSTATION), substation=SUBSTATION,
          key="question_customers_near_substation_masked")


# ---------------------------------------------------------------- layers and selection

def _layer(name: str, sql: str, **filters):
    @check(f"layer_{name}", sql)
    def run(spark, folder):
        return layers.layer(view(spark, folder), name, **filters)


_layer("substations", f"""SELECT substation_code, substation_name, s.ced_code, region_name, capacity_mva,
  {o.point('lon', 'lat')} AS geojson FROM s_substations s JOIN s_ced c ON s.ced_code = c.ced_code
  WHERE s.ced_code = '{CENTRE}'""", ced=CENTRE, line=LINE)
_layer("lines", """SELECT line_id, substation_name, ced_code, length_km, n_customers, n_transformers,
  max_distance_to_substation_m, avg_pole_age_years, part, geojson FROM g_lines JOIN paths USING (line_id)""")
_layer("right_of_way", f"""SELECT line_id, substation_name, ced_code, right_of_way_area_m2,
  {o.rnd('right_of_way_area_m2/10000', 2)} AS right_of_way_ha, part, geojson FROM g_lines
  JOIN outlines USING (line_id)""")
_layer("spans", f"""SELECT span_id, line_id, ced_code, {o.rnd('length_m', 1)} AS length_m,
  {o.linestring('lon1', 'lat1', 'lon2', 'lat2')} AS geojson FROM s_spans JOIN line_regions USING (line_id)""")
_layer("poles", f"""SELECT pole_id, line_id, ced_code, install_year, age_years, material, branch_type,
  {o.rnd('network_distance_m', 0)} AS network_distance_m, {o.point('lon', 'lat')} AS geojson FROM g_poles
  WHERE ced_code = '{CENTRE}'""", ced=CENTRE)
_layer("transformers", f"""SELECT t.transformer_id, t.line_id, t.ced_code, t.zone_id, t.kva, t.install_year,
  t.n_customers, t.max_overload_pct_hiver_{o.FEATURE}, t.max_overload_pct_hiver_{o.LABEL},
  {o.rnd('r.risk_score', 3)} AS risk_score, r.risk_tier, {o.point('t.lon', 't.lat')} AS geojson
  FROM g_transformers t LEFT JOIN tx_risk r USING (transformer_id)""")
_layer("zones", """SELECT zone_id, device_type, line_id, ced_code, n_customers, interruptions_3m, interruptions_6m,
  chi_6m, risk_tier, risk_score, geojson FROM g_zone_risk JOIN zone_text USING (zone_id)
  WHERE device_type = 'COUPE-CIRCUIT'""")
_layer("chi_hex", f"""SELECT hex_cell_8, ced_code, chi_6m, zones_impacted, geojson FROM g_hex JOIN hex_text
  USING (hex_cell_8) WHERE ced_code = '{CENTRE}'""", ced=CENTRE, line=LINE)
_layer("outages_active", f"""SELECT outage_id, zone_id, line_id, ced_code, cause, customers_interrupted,
  CAST(start_ts AS VARCHAR) AS start_ts, {o.rnd('duration_h', 1)} AS elapsed_h, {o.point('fault_lon', 'fault_lat')}
  AS geojson FROM g_outages WHERE is_ongoing""")
_layer("devices", f"""SELECT device_id, device_type, line_id, ced_code, customers_downstream,
  {o.point('lon', 'lat')} AS geojson FROM g_devices WHERE device_type = 'COUPE-CIRCUIT'""")

o.STEPS["sel"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE, {i})"
    for i, (a, b) in enumerate(zip(SELECTION, SELECTION[1:]))) + ") t(px, py, qx, qy, i)"
o.STEPS["sel_m"] = f"""SELECT {o.x_m('px', 'py')} AS x1, {o.y_m('px', 'py')} AS y1, {o.x_m('qx', 'qy')} AS x2,
  {o.y_m('qx', 'qy')} AS y2 FROM sel"""
_IN = ("NOT EXISTS (SELECT 1 FROM sel WHERE (qx-px)*({0}lat-py) - (qy-py)*({0}lon-px) < 0)")
_SIDE = "((qx-px)*(lat{0}-py) - (qy-py)*(lon{0}-px))"
o.STEPS["sel_clip"] = f"""SELECT span_id, any_value(lon1) AS lon1, any_value(lat1) AS lat1, any_value(lon2) AS lon2,
  any_value(lat2) AS lat2,
  greatest(0, max(CASE WHEN {_SIDE.format(1)} < 0 AND {_SIDE.format(2)} >= 0
    THEN {_SIDE.format(1)}/({_SIDE.format(1)} - {_SIDE.format(2)}) ELSE 0 END)) AS t0,
  least(1, min(CASE WHEN {_SIDE.format(2)} < 0 AND {_SIDE.format(1)} >= 0
    THEN {_SIDE.format(1)}/({_SIDE.format(1)} - {_SIDE.format(2)}) ELSE 1 END)) AS t1
  FROM s_spans, sel GROUP BY span_id HAVING NOT bool_or({_SIDE.format(1)} < 0 AND {_SIDE.format(2)} < 0)"""
o._CHAINS.update({flag: o._chain(flag) for flag in (False, True)})
_CUT = {c: f"lon1 + {c}*(lon2-lon1)" for c in ("t0", "t1")}, {c: f"lat1 + {c}*(lat2-lat1)" for c in ("t0", "t1")}


_SELECTION_TOTALS = f"""SELECT (SELECT count(*) FROM g_poles p WHERE {_IN.format('p.')}) AS poles,
  (SELECT count(*) FROM g_poles p WHERE {_IN.format('p.')} AND install_year < 1985) AS poles_pre_1985,
  (SELECT count(*) FROM g_transformers p WHERE {_IN.format('p.')}) AS transformers,
  (SELECT count(*) FROM g_transformers p WHERE {_IN.format('p.')} AND max_overload_pct_hiver_{o.LABEL} > 150)
    AS transformers_over_150,
  (SELECT count(*) FROM g_customers_masked p WHERE {_IN.format('p.')}) AS customers,
  (SELECT {o.rnd('sum(sqrt((xb-xa)**2 + (yb-ya)**2))/1000', 2)} FROM (SELECT
    {o.x_m(_CUT[0]['t0'], _CUT[1]['t0'])} AS xa, {o.y_m(_CUT[0]['t0'], _CUT[1]['t0'])} AS ya,
    {o.x_m(_CUT[0]['t1'], _CUT[1]['t1'])} AS xb, {o.y_m(_CUT[0]['t1'], _CUT[1]['t1'])} AS yb
    FROM sel_clip WHERE t1 > t0)) AS conductor_km,
  (SELECT {o.rnd('abs(sum(x1*y2 - x2*y1))/2e6::DOUBLE', 3)} FROM sel_m) AS area_km2"""


@check("selection_totals", _SELECTION_TOTALS)
def selection_totals(spark, folder):
    return layers.selection_totals(view(spark, folder), SELECTION_JSON)


@check("selection_top", f"""SELECT p.transformer_id, p.line_id, p.kva, p.max_overload_pct_hiver_{o.LABEL},
  {o.rnd('r.risk_score', 3)} AS risk_score, r.risk_tier FROM g_transformers p JOIN tx_risk r USING (transformer_id)
  WHERE {_IN.format('p.')} ORDER BY r.risk_score DESC, p.transformer_id LIMIT 10""")
def selection_top(spark, folder):
    return layers.selection_top(view(spark, folder), SELECTION_JSON)


@check("overload_slider", f"""SELECT transformer_id, max_overload_pct_hiver_{o.LABEL} FROM g_transformers
  WHERE coalesce(max_overload_pct_hiver_{o.LABEL}, 0) >= 120""")
def overload_slider(spark, folder):
    column = f"max_overload_pct_hiver_{LABEL_WINTER}"
    units = network(spark, folder).table("gold.transformers")
    return layers.at_least_overloaded(units, column, 120.0).select("transformer_id", column)


@check("line_list", """SELECT line_id, substation_code, substation_name, ced_code, region_name, length_km, n_customers
  FROM g_lines""")
def line_list(spark, folder):
    return layers.line_list(view(spark, folder))


@check("centre_list", "SELECT ced_code, ced_name, region_name FROM s_ced")
def centre_list(spark, folder):
    return layers.centre_list(view(spark, folder))


@check("centre_bounds", "SELECT ced_code, west AS xmin, south AS ymin, east AS xmax, north AS ymax FROM s_ced")
def centre_bounds(spark, folder):
    return layers.centre_bounds(view(spark, folder))


@check("line_bounds", f"""SELECT line_id, {o.rnd('min(least(lon1, lon2))', 7)} AS xmin,
  {o.rnd('min(least(lat1, lat2))', 7)} AS ymin, {o.rnd('max(greatest(lon1, lon2))', 7)} AS xmax,
  {o.rnd('max(greatest(lat1, lat2))', 7)} AS ymax FROM s_spans GROUP BY 1""")
def line_bounds(spark, folder):
    return rounded(layers.line_bounds(view(spark, folder)), 7, "xmin", "ymin", "xmax", "ymax")


@check("features_from_wkt", f"""
  SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {o.num('lon')} || ',' || {o.num('lat')} ||
    ']}},"properties":{{"id":"' || pole_id || '"}}}}' AS feature FROM s_poles
  UNION ALL SELECT '{{"type":"Feature","geometry":' || {o.linestring('lon1', 'lat1', 'lon2', 'lat2')} ||
    ',"properties":{{"id":"' || span_id || '"}}}}' FROM s_spans
  UNION ALL SELECT '{{"type":"Feature","geometry":{{"type":"MultiPoint","coordinates":[[' || {o.num('lon1')} || ',' ||
    {o.num('lat1')} || '],[' || {o.num('lon2')} || ',' || {o.num('lat2')} || ']]}},"properties":{{"id":"M' || span_id ||
    '"}}}}' FROM s_spans
  UNION ALL SELECT '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || west || ',44.2],[' || east ||
    ',44.2],[' || east || ',62.5],[' || west || ',62.5],[' || west || ',44.2]]]}},"properties":{{"id":"' || ced_code ||
    '"}}}}' FROM s_ced""")
def features_from_wkt(spark, folder):
    net = network(spark, folder)
    spans = net.table("silver.spans")
    point, path = F.expr(shapes.point_wkt()), F.expr(shapes.line_wkt())
    # dialects: an SRID prefix, a Z value, inner brackets of a multipoint
    poles = net.table("silver.poles").select(F.col("pole_id").alias("id"), F.concat(
        F.lit("SRID=4326;"), F.regexp_replace(F.regexp_replace(point, r"\)$", " 7.5)"), "POINT ", "POINT Z ")).alias("wkt"))
    lines = spans.select(F.col("span_id").alias("id"), path.alias("wkt"))
    ends = spans.select(F.concat(F.lit("M"), "span_id").alias("id"), F.regexp_replace(
        F.regexp_replace(path, r"LINESTRING \((.*), (.*)\)", "MULTIPOINT (($1), ($2))"), "  ", " ")
        .alias("wkt"))
    areas = net.latest("ced").select(F.col("ced_code").alias("id"), F.col("boundary_wkt").alias("wkt"))
    return to_features(poles.unionByName(lines).unionByName(ends).unionByName(areas))


# ---------------------------------------------------------------- operational tables

@check("ops_transformer_status", f"SELECT * REPLACE ({_r(7, 'lon', 'lat')}) FROM ops_transformers")
def ops_transformer_status(spark, folder):
    return rounded(network(spark, folder).table("gold.ops_transformer_status").drop("updated_at"), 7, "lon", "lat")


@check("ops_zone_risk", f"""SELECT zone_id, device_type, line_id, substation_code, ced_code, n_customers,
  interruptions_3m, interruptions_6m, chi_6m, chi_trend_pct, avg_pole_age_years, high_risk_transformers, risk_score,
  risk_tier, CASE WHEN risk_tier = 'ÉLEVÉ' THEN 'Inspecter ' || zone_id END AS recommendation_fr,
  CASE WHEN risk_tier = 'ÉLEVÉ' THEN 'Inspect ' || zone_id END AS recommendation_en,
  {o.rnd('centroid_lon', 7)} AS lon, {o.rnd('centroid_lat', 7)} AS lat FROM g_zone_risk JOIN zone_centres USING (zone_id)""")
def ops_zone_risk(spark, folder):
    net = network(spark, folder)
    high = net.shared("gold.zone_risk").filter(F.col("risk_tier") == "ÉLEVÉ")
    net.replies = high.select("zone_id", F.concat(
        F.lit("Inspecter "), "zone_id", F.lit(" || Inspect "), "zone_id").alias("recommendation"))
    return rounded(net.table("gold.ops_zone_risk").drop("updated_at"), 7, "lon", "lat")


@check("ops_active_outages", """SELECT outage_id, zone_id, device_type, line_id, substation_code, ced_code, start_ts,
  cause, customers_interrupted, duration_h AS elapsed_h, chi AS chi_so_far, fault_lon AS lon, fault_lat AS lat
  FROM g_outages WHERE is_ongoing""")
def ops_active_outages(spark, folder):
    return network(spark, folder).table("gold.ops_active_outages").drop("updated_at")


@check("ops_line_status", f"SELECT * REPLACE ({o.rnd('chi_6m', 3)} AS chi_6m) FROM ops_lines")
def ops_line_status(spark, folder):
    return rounded(network(spark, folder).table("gold.ops_line_status").drop("updated_at"), 3, "chi_6m")


@check("panel_summary", "SELECT * FROM ops_summary")
def panel_summary(spark, folder):
    return ops.centre_summary(network(spark, folder).table("gold.ops_line_status"))


@check("panel_totals", """SELECT CAST(sum(active_outages) AS BIGINT) AS active_outages, CAST(sum(customers_out) AS
  BIGINT) AS customers_out, CAST(sum(high_risk_transformers) AS BIGINT) AS high_risk_transformers FROM ops_summary""")
def panel_totals(spark, folder):
    return ops.totals_strip(ops.centre_summary(network(spark, folder).table("gold.ops_line_status")))


@check("panel_outages", f"""SELECT outage_id, zone_id, line_id, ced_code, cause, customers_interrupted,
  {o.rnd('duration_h', 1)} AS elapsed_h, {o.rnd('chi', 0)} AS chi_so_far, fault_lon AS lon, fault_lat AS lat
  FROM g_outages WHERE is_ongoing AND ced_code = '{CENTRE}'""")
def panel_outages(spark, folder):
    return ops.outage_panel(network(spark, folder).table("gold.ops_active_outages"), CENTRE)


@check("panel_zones", f"""SELECT zone_id, line_id, ced_code, n_customers, interruptions_6m, {o.rnd('chi_6m', 0)} AS chi_6m,
  chi_trend_pct, avg_pole_age_years, high_risk_transformers, risk_score, risk_tier,
  CAST(NULL AS VARCHAR) AS recommendation_fr, CAST(NULL AS VARCHAR) AS recommendation_en,
  {o.rnd('centroid_lon', 7)} AS lon, {o.rnd('centroid_lat', 7)} AS lat FROM g_zone_risk JOIN zone_centres USING (zone_id)
  ORDER BY risk_score DESC, zone_id LIMIT 15""")
def panel_zones(spark, folder):
    return rounded(ops.zone_panel(network(spark, folder).table("gold.ops_zone_risk")), 7, "lon", "lat")


@check("panel_transformers", f"""SELECT transformer_id, line_id, ced_code, kva, n_customers,
  max_overload_pct_last_winter, risk_score_next_winter, risk_tier, {_r(7, 'lon', 'lat')} FROM ops_transformers
  WHERE ced_code = '{CENTRE}' ORDER BY risk_score_next_winter DESC NULLS LAST, transformer_id LIMIT 500""")
def panel_transformers(spark, folder):
    status = network(spark, folder).table("gold.ops_transformer_status")
    return rounded(ops.transformer_panel(status, CENTRE, limit=500), 7, "lon", "lat")


# ---------------------------------------------------------------- incremental jobs

# two states of the transformers: the second lacks ids ending in 5 and has ids ending in 3
_BEFORE = "right(transformer_id, 1) <> '3'"
_AFTER = "right(transformer_id, 1) <> '5'"
_COLUMNS = ("transformer_id", "pole_id", "kva", "install_year", "phase", "manufacturer")
_AFTER_VALUES = {"manufacturer": "CASE WHEN right(transformer_id, 1) = '0' THEN 'RENEWED' ELSE manufacturer END"}


def _before(net: Network) -> DataFrame:
    return net.table("silver.transformers").select(*_COLUMNS).filter(_BEFORE)


def _after(net: Network) -> DataFrame:
    return net.table("silver.transformers").select(*_COLUMNS).filter(_AFTER).withColumns(
        {c: F.expr(e) for c, e in _AFTER_VALUES.items()})


@check("snapshot_changes", f"""SELECT CASE WHEN right(transformer_id, 1) = '3' THEN 'I'
    WHEN right(transformer_id, 1) = '5' THEN 'D' ELSE 'U' END AS _op, {', '.join(_COLUMNS[:-1])},
  {_AFTER_VALUES['manufacturer']} AS manufacturer FROM s_transformers WHERE right(transformer_id, 1) IN ('0', '3', '5')""")
def snapshot_changes(spark, folder):
    net = network(spark, folder)
    return changes(_before(net), _after(net), "transformer_id")


@check("stream_sync", f"""SELECT {', '.join(_COLUMNS[:-1])}, {_AFTER_VALUES['manufacturer']} AS manufacturer
  FROM s_transformers WHERE {_AFTER}""")
def stream_sync(spark, folder):
    """Two merges into a keyed table, followed by a mirror through its change feed."""
    net = network(spark, folder)
    root = scratch_path(spark, "sync")
    source = KeyedTable(TableStore(spark, f"{root}/source"), "transformers", "transformer_id")
    mirror = Mirror(source, TableStore(spark, f"{root}/mirror"))
    for state in (_before(net), _after(net)):
        source.merge(state)
        mirror.sync()
    return mirror.rows()


@check("stream_ingest", f"""SELECT pole_id, line_id, branch_id, branch_seq, parent_pole_id, install_year, age_years,
  material, height_m, {_r(7, 'lon', 'lat')} FROM s_poles""", landed=True)
def stream_ingest(spark, folder):
    """Poles land as CSV, twice; each run reads only what is new, silver keeps the latest."""
    tables = MappedTables(tune(spark), folder)
    root = scratch_path(spark, "landing")
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    landed = landed_twice(tables)("poles")
    for file in ("a", "b"):
        batch = landed.filter(F.col("_source_file") == file).drop("_source_file", "_ingested_at")
        batch.write.mode("append").csv(landing.folder("poles"), header=True)
        landing.ingest("poles")
    settings = Settings(AS_OF, FEATURE_WINTER, LABEL_WINTER)
    silver = Network(spark, landing.bronze, settings).table("silver.poles")
    return rounded(silver.drop("x", "y", "hex_cell_9"), 7, "lon", "lat")


# extract -> (id column, summed column, column whose values of ids ending in 7 land as a word the second time)
_MEASURES = {
    "ced": ("ced_code", "CAST(is_urban AS INT)", None), "substations": ("substation_code", "capacity_mva", None),
    "lines": ("line_id", "commissioning_year", "commissioning_year"), "poles": ("pole_id", "install_year", "install_year"),
    "transformers": ("transformer_id", "kva", None), "protection_devices": ("line_id", "rating_a", "rating_a"),
    "customers": ("customer_id", "contract_kw", "contract_kw"), "outages": ("outage_id", "customers_interrupted", None),
    "weather": ("date", "temp_min_c", None), "transformer_load": ("transformer_id", "peak_kva", None),
}


def _ingested_sql(name: str) -> str:
    key, measure, misfit = _MEASURES[name]
    again = "FALSE" if name == "transformer_load" else "landed = 1"
    lost = f"{again} AND right(CAST({key} AS VARCHAR), 1) = '7'" if misfit else "FALSE"
    return (f"SELECT '{name}' AS extract, count(*) AS n_rows, count(*) FILTER (WHERE {again}) AS n_added, "
            f"count(*) FILTER (WHERE {lost}) AS n_rescued, count(DISTINCT {key}) AS n_ids, "
            f"CAST(coalesce(sum({measure}) FILTER (WHERE NOT ({lost})), 0) AS DOUBLE) AS total "
            f"FROM {'x' if name == 'transformer_load' else 'l'}_{name}")


@check("stream_ingest_all", " UNION ALL ".join(map(_ingested_sql, _MEASURES)), landed=True)
def stream_ingest_all(spark, folder):
    """All ten extracts land in their formats, twice; the second files are ordered the other way round, have one column
    more, and words where numbers belong. Every run takes all extracts of the registry, the last one finds nothing."""
    extract = landed_twice(MappedTables(tune(spark), folder))
    root = scratch_path(spark, "landing")
    landing = Landing(spark, f"{root}/landed", f"{root}/bronze")
    for file in ("a", "b"):
        for name, entity in EXTRACTS.items():
            rows = extract(name)
            key, _, misfit = _MEASURES[name]
            if "_source_file" in rows.columns:
                rows = rows.filter(F.col("_source_file") == file).drop("_source_file", "_ingested_at")
            elif file == "b":
                continue
            parts = [rows]
            if file == "b":
                rows = rows.withColumn("inspected", F.lit(5)).select("inspected", *reversed(rows.columns))
                wrong = F.right(F.col(key).cast("string"), F.lit(1)) == "7"
                # numbers and words in files of their own: JSON would write all of them as text
                parts = [rows.filter(~wrong), rows.filter(wrong).withColumn(misfit, F.lit("unknown"))] if misfit else [rows]
            for part in parts:
                writer = part.write.mode("append").format(entity.format)
                (writer.option("header", "true") if entity.format == "csv" else writer).save(landing.folder(name))
        landing.ingest_all()
    again = {name: n for name, n in landing.ingest_all().items() if n}
    if again:
        raise RuntimeError(f"files were read again: {again}")

    def totals(name: str) -> DataFrame:
        key, measure, _ = _MEASURES[name]
        rows, rescued = landing.bronze(name), landing.rescued(name)
        added = F.count("inspected") if "inspected" in rows.columns else F.lit(0).cast("long")
        counted = rows.agg(F.count("*").alias("n_rows"), added.alias("n_added"), F.count_distinct(key).alias("n_ids"),
                           F.coalesce(F.sum(F.expr(measure)), F.lit(0)).cast("double").alias("total"))
        kept = rescued.agg(F.count(key).alias("n_rescued"))
        return counted.join(F.broadcast(kept), F.lit(True)).select(F.lit(name).alias("extract"), "*")  # one row each

    return reduce(DataFrame.unionByName, map(totals, EXTRACTS))


@check("change_feed", f"""SELECT 1 AS change_version, 'I' AS _op, {', '.join(_COLUMNS)} FROM s_transformers WHERE {_BEFORE}
  UNION ALL SELECT 2, CASE WHEN right(transformer_id, 1) = '3' THEN 'I' WHEN right(transformer_id, 1) = '5' THEN 'D' ELSE 'U' END,
  {', '.join(_COLUMNS[:-1])}, {_AFTER_VALUES['manufacturer']} FROM s_transformers WHERE right(transformer_id, 1) IN ('0', '3', '5')""")
def change_feed(spark, folder):
    """What two merges into a keyed table leave in its feed; a third one that changes nothing leaves nothing."""
    net = network(spark, folder)
    table = KeyedTable(TableStore(spark, scratch_path(spark, "feed")), "transformers", "transformer_id")
    for state in (_before(net), _after(net), _after(net)):
        table.merge(state)
    return spark.read.parquet(table.feed_path).select("change_version", "_op", *_COLUMNS)


def _stored(spark, folder, names: tuple[str, ...]) -> SecuredView:
    """A view of these products as stored; the extracts are out of reach by then."""
    net = network(spark, folder)
    net.store = TableStore(spark, scratch_path(spark, "tables"))
    for name in names:
        net.store.replace(name, net.table(name))
        net.forget(name)

    def nothing(name: str) -> DataFrame:
        raise RuntimeError(f"{name} is read from its extract")

    stored = Network(spark, nothing, net.settings, store=net.store)
    return SecuredView(stored, MASKED_CALLER, access(stored))


@check("stored_oldest_poles", _OLDEST_POLES, landed=True)
def stored_oldest_poles(spark, folder):
    """A question answered from stored products alone."""
    return questions.ask(_stored(spark, folder, ("silver.operating_centers", "silver.poles", "gold.poles")), "oldest_poles", line=LINE)


@check("stored_selection_totals", _SELECTION_TOTALS)
def stored_selection_totals(spark, folder):
    """What lies inside a drawn polygon, from stored products that are laid by place."""
    names = ("silver.operating_centers", "silver.poles", "gold.poles", "gold.spans", "gold.transformers", "gold.customers_pii")
    return layers.selection_totals(_stored(spark, folder, names), SELECTION_JSON)
