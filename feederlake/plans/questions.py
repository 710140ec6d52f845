"""The fixed questions, as functions of their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.calendar import since_months, winter_name
from feederlake.functions.shapes import line_geojson, multipolygon_geojson, point_geojson, polygon_geojson
from feederlake.operators.ranks import global_percent_rank
from feederlake.operators.spatial import join_containing, join_within
from feederlake.plans.gold import zone_outlines
from feederlake.plans.secured import SecuredView
from feederlake.schemas import OLD_ASSET_YEAR, OVERLOAD_PCT, TIER_HIGH
from feederlake.session import settle

def _here():
    return F.expr(point_geojson()).alias("geojson")


def with_zone_outline(view: SecuredView, rows: DataFrame) -> DataFrame:
    """Attach zone outlines to a few result rows; other zones' hulls are not computed.

    The rows are settled first: they both choose the hulls and carry the answer.
    """
    rows = settle(rows, "zones")
    outlines = zone_outlines(view.net, only=rows).select(
        "zone_id", F.expr(polygon_geojson("array(zone_ring)")).alias("geojson"))
    return rows.join(outlines, "zone_id")


def old_transformers_in_region(view: SecuredView, region: str, before: int = OLD_ASSET_YEAR) -> DataFrame:
    """Transformers installed before a year inside a region's territory."""
    territory = view.table("gold.operating_centers").filter(F.col("region_name") == region).select("rings")
    old = view.table("gold.transformers").filter(F.col("install_year") < before)
    return (join_containing(old, territory, "rings")
            .select("transformer_id", "line_id", "substation_code", "install_year", "kva", "n_customers", "lon",
                    "lat", _here())
            .orderBy("install_year", "transformer_id"))


def device_impact(view: SecuredView, device: str) -> DataFrame:
    """Customers and transformers lost when a device operates, with its zone."""
    lost = view.table("gold.protection_devices").filter(F.col("device_id") == device).select(
        F.col("device_id").alias("zone_id"), "device_type", "line_id",
        F.col("customers_downstream").alias("clients_affectes"),
        F.col("transformers_downstream").alias("transformateurs_affectes"))
    return with_zone_outline(view, lost).withColumnRenamed("zone_id", "device_id")


def line_reach(view: SecuredView, line: str) -> DataFrame:
    """Largest straight and network distance to the substation on a line."""
    return view.table("gold.poles").filter(F.col("line_id") == line).groupBy("line_id").agg(
        F.round(F.max("distance_to_substation_m")).alias("distance_max_vol_oiseau_m"),
        F.round(F.max("network_distance_m")).alias("distance_max_le_long_de_la_ligne_m"))


def _zone_events(view: SecuredView, months: int) -> DataFrame:
    recent = since_months(F.col("start_ts"), view.net.settings.as_of, months)
    events = view.table("gold.outages").filter(recent).groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("nb_interruptions"), F.round(F.sum("chi"), 1).alias("chi"))
    zones = view.table("gold.zone_summary").select("zone_id", "device_type", "line_id", "region_name", "n_customers")
    return events.join(zones, "zone_id")


def most_interrupted_zones(view: SecuredView, months: int = 3, top: int = 10) -> DataFrame:
    best = _zone_events(view, months).orderBy(F.desc("nb_interruptions"), F.desc("chi"), "zone_id").limit(top)
    return with_zone_outline(view, best).orderBy(F.desc("nb_interruptions"), F.desc("chi"), "zone_id")


def highest_chi_zones(view: SecuredView, months: int = 6, top: int = 10) -> DataFrame:
    best = (_zone_events(view, months).withColumnRenamed("chi", "chi_6_mois")
            .orderBy(F.desc("chi_6_mois"), "zone_id").limit(top))
    return with_zone_outline(view, best).orderBy(F.desc("chi_6_mois"), "zone_id")


def right_of_way(view: SecuredView, substation: str) -> DataFrame:
    """Right-of-way area of each line of a substation, one row per line."""
    lines = view.table("gold.lines").filter(F.col("substation_name") == substation).select(
        "line_id", "substation_name", "length_km", F.col("right_of_way_area_m2").alias("emprise_m2"))
    hectares = view.table("gold.line_areas").select("line_id", F.round(F.col("area_m2") / 10000, 2).alias("emprise_ha"))
    return lines.join(hectares, "line_id", "left").orderBy("line_id")


def right_of_way_shapes(view: SecuredView, substation: str) -> DataFrame:
    """The outlines that belong to right_of_way, in pieces of a branch."""
    lines = view.table("gold.lines").filter(F.col("substation_name") == substation).select("line_id")
    shapes = view.table("gold.line_shapes").select(
        "line_id", "part", F.expr(multipolygon_geojson("outlines")).alias("geojson"))
    return lines.join(shapes, "line_id").orderBy("line_id", "part")


def farthest_customers(view: SecuredView, ced: str, share: float = 0.01) -> DataFrame:
    """The share of a centre's customers farthest from their substation."""
    customers = view.table("gold.customers").filter(F.col("ced_code") == ced).select(
        "customer_id", "line_id", "substation_code", "municipality", "distance_to_substation_m",
        "network_distance_m", "lon", "lat")
    customers = view.net.settled("centre-customers", customers)
    ranked = global_percent_rank(customers, "distance_to_substation_m", "pct_rank", descending=True)
    return (ranked.filter(F.col("pct_rank") <= share)
            .select("customer_id", "line_id", "substation_code", "municipality",
                    F.round("distance_to_substation_m").alias("distance_vol_oiseau_m"),
                    F.round("network_distance_m").alias("distance_reseau_m"), _here(), "distance_to_substation_m")
            .orderBy(F.desc("distance_to_substation_m"), "customer_id").drop("distance_to_substation_m"))


def overloaded_transformers(view: SecuredView, line: str, winter: int, over: float = OVERLOAD_PCT) -> DataFrame:
    """Transformers of a line above a load level in a winter."""
    days = (view.table("gold.transformer_load_daily")
            .filter((F.col("line_id") == line) & (F.col("winter_label") == winter_name(winter))
                    & (F.col("overload_pct") > over))
            .groupBy("transformer_id").agg(
                F.max("overload_pct").alias("surcharge_max_pct"), F.count(F.lit(1)).alias("jours_sup_150"),
                F.min("reading_date").alias("premier_jour"), F.max("reading_date").alias("dernier_jour")))
    units = view.table("gold.transformers").select("transformer_id", "kva", "n_customers", _here())
    return units.join(days, "transformer_id").orderBy(F.desc("surcharge_max_pct"), "transformer_id")


def oldest_poles(view: SecuredView, line: str, top: int = 20) -> DataFrame:
    return (view.table("gold.poles").filter(F.col("line_id") == line)
            .select("pole_id", "install_year", "age_years", "material", "branch_type",
                    F.round("network_distance_m").alias("distance_reseau_m"), _here())
            .orderBy("install_year", "pole_id").limit(top))


def longest_spans(view: SecuredView, top: int = 20) -> DataFrame:
    path = F.expr(line_geojson())
    return (view.table("gold.spans")
            .select("span_id", "line_id", "region_name", "from_node_id", "to_pole_id",
                    F.col("length_m").alias("longueur_m"), path.alias("geojson"))
            .orderBy(F.desc("longueur_m"), "span_id").limit(top))


def riskiest_transformers(view: SecuredView, top: int = 20) -> DataFrame:
    risk = view.table("gold.transformer_risk").select(
        "transformer_id", "line_id", "ced_code", F.round(F.lit(100.0) * F.col("risk_score"), 1).alias("risque_pct"),
        "risk_tier", "max_overload_pct_last_winter", "risk_score")
    best = risk.orderBy(F.desc("risk_score"), "transformer_id").limit(top)
    places = view.table("gold.transformers").select("transformer_id", _here())
    return best.join(places, "transformer_id").orderBy(F.desc("risk_score"), "transformer_id").drop("risk_score")


def high_risk_zones(view: SecuredView) -> DataFrame:
    risky = view.table("gold.zone_risk").filter(F.col("risk_tier") == TIER_HIGH).select(
        "zone_id", "line_id", "region_name", "risk_score", "chi_6m", "chi_trend_pct", "avg_pole_age_years",
        "high_risk_transformers")
    return with_zone_outline(view, risky).orderBy(F.desc("risk_score"), "zone_id")


def ongoing_outages(view: SecuredView) -> DataFrame:
    place = F.expr(point_geojson("fault_lon", "fault_lat"))
    return (view.table("gold.outages").filter("is_ongoing")
            .select("outage_id", "zone_id", "line_id", "region_name", "start_ts", "cause", "customers_interrupted",
                    F.round("duration_h", 1).alias("duree_h"), place.alias("geojson"))
            .orderBy(F.desc("customers_interrupted"), "outage_id"))


def customers_near_substation(view: SecuredView, substation: str, metres: float = 500.0) -> DataFrame:
    """How many customers, at the location the caller may see, lie within a distance."""
    centre = view.table("gold.substations").filter(F.col("substation_name") == substation).select(
        F.col("x").alias("cx"), F.col("y").alias("cy"))
    return join_within(view.customer_places(), centre, metres).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nb_clients"))


QUESTIONS = {
    "old_transformers_in_region": old_transformers_in_region,
    "device_impact": device_impact,
    "line_reach": line_reach,
    "most_interrupted_zones": most_interrupted_zones,
    "highest_chi_zones": highest_chi_zones,
    "right_of_way": right_of_way,
    "right_of_way_shapes": right_of_way_shapes,
    "farthest_customers": farthest_customers,
    "overloaded_transformers": overloaded_transformers,
    "oldest_poles": oldest_poles,
    "longest_spans": longest_spans,
    "riskiest_transformers": riskiest_transformers,
    "high_risk_zones": high_risk_zones,
    "ongoing_outages": ongoing_outages,
    "customers_near_substation": customers_near_substation,
}


def ask(view: SecuredView, question: str, *, limit: int | None = None, **parameters) -> DataFrame:
    """Answer a question by name: every row, or the first `limit`."""
    rows = QUESTIONS[question](view, **parameters)
    return rows if limit is None else rows.limit(limit)


def ask_counted(view: SecuredView, question: str, limit: int, **parameters) -> tuple[DataFrame, int]:
    """The first `limit` rows, and how many there are in all."""
    rows = settle(QUESTIONS[question](view, **parameters).withColumn("_place", F.monotonically_increasing_id()), "answer")
    return rows.orderBy("_place").limit(limit).drop("_place"), rows.count()
