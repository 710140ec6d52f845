"""Map layers, selections and the lists a map starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.shapes import (
    line_geojson,
    multiline_geojson,
    multipolygon_geojson,
    point_geojson,
    polygon_area_m2,
    polygon_geojson,
    rings_literal,
)
from feederlake.functions.shapes import bounds as ring_bounds
from feederlake.operators.spatial import (
    box_test,
    clipped_length_m,
    edges_literal,
    polygon_literal,
    touches_point,
    touches_segment,
    with_cuts,
)
from feederlake.plans.gold import zone_outlines
from feederlake.plans.secured import SecuredView
from feederlake.schemas import CUTOUT, OLD_ASSET_YEAR, OVERLOAD_PCT

NO_LINE_FILTER = ("substations", "chi_hex")


def _point(lon: str = "lon", lat: str = "lat"):
    return F.expr(point_geojson(lon, lat)).alias("geojson")


def _substations(view: SecuredView, keep) -> DataFrame:
    return keep(view.table("gold.substations")).select(
        "substation_code", "substation_name", "ced_code", "region_name", "capacity_mva", _point())


def _lines(view: SecuredView, keep) -> DataFrame:
    shapes = view.table("gold.line_shapes").select(
        "line_id", "part", F.expr(multiline_geojson("paths")).alias("geojson"))
    return keep(view.table("gold.lines")).select(
        "line_id", "substation_name", "ced_code", "length_km", "n_customers", "n_transformers",
        "max_distance_to_substation_m", "avg_pole_age_years").join(shapes, "line_id")


def _right_of_way(view: SecuredView, keep) -> DataFrame:
    shapes = view.table("gold.line_shapes").select(
        "line_id", "part", F.expr(multipolygon_geojson("outlines")).alias("geojson"))
    return keep(view.table("gold.lines")).select(
        "line_id", "substation_name", "ced_code", "right_of_way_area_m2",
        F.round(F.col("right_of_way_area_m2") / 10000, 2).alias("right_of_way_ha")).join(shapes, "line_id")


def _spans(view: SecuredView, keep) -> DataFrame:
    path = F.expr(line_geojson())
    return keep(view.table("gold.spans")).select("span_id", "line_id", "ced_code", "length_m", path.alias("geojson"))


def _poles(view: SecuredView, keep) -> DataFrame:
    return keep(view.table("gold.poles")).select(
        "pole_id", "line_id", "ced_code", "install_year", "age_years", "material", "branch_type",
        F.round("network_distance_m").alias("network_distance_m"), _point())


def _transformers(view: SecuredView, keep) -> DataFrame:
    first, second = view.net.settings.winters
    risk = view.table("gold.transformer_risk").select(
        "transformer_id", F.round("risk_score", 3).alias("risk_score"), "risk_tier")
    return keep(view.table("gold.transformers")).join(risk, "transformer_id", "left").select(
        "transformer_id", "line_id", "ced_code", "zone_id", "kva", "install_year", "n_customers",
        f"max_overload_pct_hiver_{first}", f"max_overload_pct_hiver_{second}", "risk_score", "risk_tier", _point())


def _zones(view: SecuredView, keep) -> DataFrame:
    zones = keep(view.table("gold.zone_summary").filter(F.col("device_type") == CUTOUT)).select(
        "zone_id", "device_type", "line_id", "ced_code", "n_customers", "interruptions_3m", "interruptions_6m",
        "chi_6m")
    risk = view.table("gold.zone_risk").select("zone_id", "risk_tier", "risk_score")
    shown = keep(view.table("gold.protection_devices").filter(F.col("device_type") == CUTOUT))
    outlines = zone_outlines(view.net, only=shown.select(F.col("device_id").alias("zone_id"))).select(
        "zone_id", F.expr(polygon_geojson("array(zone_ring)")).alias("geojson"))
    return zones.join(risk, "zone_id", "left").join(outlines, "zone_id")


def _chi_hex(view: SecuredView, keep) -> DataFrame:
    return keep(view.table("gold.chi_hex")).select(
        "hex_cell_8", "ced_code", "chi_6m", "zones_impacted",
        F.expr(polygon_geojson("array(cell_ring)")).alias("geojson"))


def _outages_active(view: SecuredView, keep) -> DataFrame:
    return keep(view.table("gold.outages").filter("is_ongoing")).select(
        "outage_id", "zone_id", "line_id", "ced_code", "cause", "customers_interrupted",
        F.col("start_ts").cast("string").alias("start_ts"), F.round("duration_h", 1).alias("elapsed_h"),
        _point("fault_lon", "fault_lat"))


def _devices(view: SecuredView, keep) -> DataFrame:
    return keep(view.table("gold.protection_devices").filter(F.col("device_type") == CUTOUT)).select(
        "device_id", "device_type", "line_id", "ced_code", "customers_downstream", _point())


LAYERS = {
    "substations": _substations,
    "lines": _lines,
    "right_of_way": _right_of_way,
    "spans": _spans,
    "poles": _poles,
    "transformers": _transformers,
    "zones": _zones,
    "chi_hex": _chi_hex,
    "outages_active": _outages_active,
    "devices": _devices,
}


def layer(view: SecuredView, name: str, ced: str | None = None, line: str | None = None) -> DataFrame:
    """A layer's rows with a ``geojson`` column; filters apply only when given."""
    if name not in LAYERS:
        raise KeyError(f"unknown layer {name}")

    def keep(df: DataFrame) -> DataFrame:
        if ced is not None:
            df = df.filter(F.col("ced_code") == ced)
        if line is not None and name not in NO_LINE_FILTER:
            df = df.filter(F.col("line_id") == line)
        return df

    return LAYERS[name](view, keep)


def at_least_overloaded(transformers: DataFrame, column: str, threshold: float) -> DataFrame:
    """The overload slider: units without a reading count as zero."""
    return transformers.filter(F.coalesce(column, F.lit(0.0)) >= threshold)


# ---------------------------------------------------------------- selection

def near_box(west: float, south: float, east: float, north: float) -> str:
    """Spans whose own box meets the box, by columns alone, so that the scan can skip what lies elsewhere."""
    return (f"(lon1 <= {east!r}D OR lon2 <= {east!r}D) AND (lon1 >= {west!r}D OR lon2 >= {west!r}D) AND "
            f"(lat1 <= {north!r}D OR lat2 <= {north!r}D) AND (lat1 >= {south!r}D OR lat2 >= {south!r}D)")


def selection_totals(view: SecuredView, geojson: str) -> DataFrame:
    """What lies inside a drawn polygon, as one row."""
    rings = rings_literal(geojson)
    edges = edges_literal(rings)
    last = f"max_overload_pct_hiver_{view.net.settings.label_winter}"

    poles = _inside(view.table("gold.poles"), rings).agg(
        F.count(F.lit(1)).alias("poles"), F.count_if(F.col("install_year") < OLD_ASSET_YEAR).alias("poles_pre_1985"))
    units = _inside(view.table("gold.transformers"), rings).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(last) > OVERLOAD_PCT).alias("over")))
    # a condition inside the sum, not a filter: masked places are tested once per cell
    lons, lats = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    homes = view.customer_places((min(lons), min(lats), max(lons), max(lats))).selectExpr("*", f"{edges} AS _edges").agg(F.expr(
        f"coalesce(sum(CASE WHEN {box_test(rings)} AND {touches_point('_edges', 'lon', 'lat')} THEN n ELSE 0 END), 0)"))
    ends = ("lon1", "lat1", "lon2", "lat2")
    met = (view.table("gold.spans").select(*ends).filter(near_box(min(lons), min(lats), max(lons), max(lats))).selectExpr("*", f"{edges} AS _edges")
           .filter(touches_segment("_edges", *ends)))  # without any the length is NULL, not 0
    wire = (with_cuts(met, *ends)
            .agg(F.expr(f"round(sum({clipped_length_m('_edges', '_cuts', *ends)}) / 1000, 2)")))
    return poles.withColumns({"_units": units.scalar(), "customers": homes.scalar(), "conductor_km": wire.scalar()}).select(
        "poles", "poles_pre_1985", F.col("_units.n").alias("transformers"),
        F.col("_units.over").alias("transformers_over_150"), "customers", "conductor_km",
        F.expr(f"round({polygon_area_m2(polygon_literal(rings))} / 1e6D, 3)").alias("area_km2"))


def _inside(df: DataFrame, rings) -> DataFrame:
    return df.filter(box_test(rings)).filter(touches_point(edges_literal(rings), "lon", "lat"))


def selection_top(view: SecuredView, geojson: str, top: int = 10) -> DataFrame:
    """The transformers most at risk inside a drawn polygon."""
    rings = rings_literal(geojson)
    last = f"max_overload_pct_hiver_{view.net.settings.label_winter}"
    units = (_inside(view.table("gold.transformers"), rings)
             .select("transformer_id", "line_id", "kva", last))
    risk = view.table("gold.transformer_risk").select("transformer_id", "risk_score", "risk_tier")
    return (units.join(risk, "transformer_id").orderBy(F.desc("risk_score"), "transformer_id").limit(top)
            .withColumn("risk_score", F.round("risk_score", 3)))


# ---------------------------------------------------------------- lists

def line_list(view: SecuredView) -> DataFrame:
    return view.table("gold.lines").select(
        "line_id", "substation_code", "substation_name", "ced_code", "region_name", "length_km",
        "n_customers").orderBy("line_id")


def centre_list(view: SecuredView) -> DataFrame:
    return view.table("gold.operating_centers").select("ced_code", "ced_name", "region_name").orderBy("ced_code")


def centre_bounds(view: SecuredView) -> DataFrame:
    box = ring_bounds("rings")
    return view.table("gold.operating_centers").selectExpr("ced_code", *[f"{v} AS {k}" for k, v in box.items()])


def line_bounds(view: SecuredView) -> DataFrame:
    return view.table("gold.line_bounds")
