"""Operational tables (scalar columns, one key each) and the panels over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.calendar import since_months
from feederlake.plans.network import Network, product
from feederlake.plans.risk import split_reply
from feederlake.schemas import TIER_HIGH

KEYS = {
    "gold.ops_transformer_status": "transformer_id",
    "gold.ops_zone_risk": "zone_id",
    "gold.ops_active_outages": "outage_id",
    "gold.ops_line_status": "line_id",
}
VOLATILE = ("updated_at",)


@product("gold.ops_transformer_status")
def transformer_status(net: Network) -> DataFrame:
    last = net.settings.label_winter
    risk = net.table("gold.transformer_risk").select("transformer_id", "risk_score", "risk_tier")
    return net.table("gold.transformers").join(risk, "transformer_id", "left").select(
        "transformer_id", "line_id", "substation_code", "ced_code", "zone_id", "kva", "n_customers",
        F.col(f"max_overload_pct_hiver_{last}").alias("max_overload_pct_last_winter"),
        F.col(f"days_over_150_hiver_{last}").alias("days_over_150_last_winter"),
        F.round("risk_score", 3).alias("risk_score_next_winter"), "risk_tier", "lon", "lat",
        net.settings.now().alias("updated_at"))


@product("gold.ops_zone_risk")
def zone_status(net: Network) -> DataFrame:
    french, english = split_reply(F.col("recommendation"))
    return (net.shared("gold.zone_risk")
            .join(net.table("gold.zone_risk_recommendations"), "zone_id", "left")
            .select("zone_id", "device_type", "line_id", "substation_code", "ced_code", "n_customers",
                    "interruptions_3m", "interruptions_6m", "chi_6m", "chi_trend_pct", "avg_pole_age_years",
                    "high_risk_transformers", "risk_score", "risk_tier", french.alias("recommendation_fr"),
                    english.alias("recommendation_en"), F.col("centroid_lon").alias("lon"),
                    F.col("centroid_lat").alias("lat"), net.settings.now().alias("updated_at")))


@product("gold.ops_active_outages")
def active_outages(net: Network) -> DataFrame:
    return net.table("gold.outages").filter("is_ongoing").select(
        "outage_id", "zone_id", "device_type", "line_id", "substation_code", "ced_code", "start_ts", "cause",
        "customers_interrupted", F.col("duration_h").alias("elapsed_h"), F.col("chi").alias("chi_so_far"),
        F.col("fault_lon").alias("lon"), F.col("fault_lat").alias("lat"), net.settings.now().alias("updated_at"))


@product("gold.ops_line_status")
def line_status(net: Network) -> DataFrame:
    # ongoing and recent figures from one pass over the outages
    recent = since_months(F.col("start_ts"), net.settings.as_of, 6)
    events = net.table("gold.outages").filter(F.col("is_ongoing") | recent).groupBy("line_id").agg(
        F.count_if("is_ongoing").alias("active_outages"),
        F.sum(F.when(F.col("is_ongoing"), F.col("customers_interrupted")).otherwise(0)).alias("customers_out"),
        F.sum(F.when(recent, F.col("chi")).otherwise(0.0)).alias("chi_6m"))
    high = net.table("gold.transformer_risk").groupBy("line_id").agg(
        F.count_if(F.col("risk_tier") == TIER_HIGH).alias("high_risk_transformers"))
    return (net.table("gold.lines").join(events, "line_id", "left").join(high, "line_id", "left")
            .select("line_id", "substation_code", "substation_name", "ced_code", "region_name", "length_km",
                    "n_customers", "n_transformers",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in
                      ("active_outages", "customers_out", "high_risk_transformers")],
                    F.coalesce("chi_6m", F.lit(0.0)).alias("chi_6m"), net.settings.now().alias("updated_at")))


# ---------------------------------------------------------------- panels

def _of_centre(df: DataFrame, ced: str | None, line: str | None = None) -> DataFrame:
    """Filters that apply only when their argument is given."""
    if ced is not None:
        df = df.filter(F.col("ced_code") == ced)
    if line is not None:
        df = df.filter(F.col("line_id") == line)
    return df


def centre_summary(lines: DataFrame, ced: str | None = None) -> DataFrame:
    total = {c: F.sum(c).alias(c) for c in ("active_outages", "customers_out", "high_risk_transformers")}
    return (_of_centre(lines, ced).groupBy("ced_code")
            .agg(F.count(F.lit(1)).alias("lines"), F.sum("n_customers").alias("customers"), *total.values(),
                 F.round(F.round(F.sum("chi_6m"), 6), 0).alias("chi_6m"))
            .orderBy("ced_code"))


def outage_panel(outages: DataFrame, ced: str | None = None) -> DataFrame:
    return (_of_centre(outages, ced)
            .select("outage_id", "zone_id", "line_id", "ced_code", "cause", "customers_interrupted",
                    F.round("elapsed_h", 1).alias("elapsed_h"), F.round("chi_so_far", 0).alias("chi_so_far"),
                    "lon", "lat")
            .orderBy(F.desc("customers_interrupted"), "outage_id"))


def zone_panel(zones: DataFrame, ced: str | None = None, limit: int = 15) -> DataFrame:
    return (_of_centre(zones, ced)
            .select("zone_id", "line_id", "ced_code", "n_customers", "interruptions_6m",
                    F.round("chi_6m", 0).alias("chi_6m"), "chi_trend_pct", "avg_pole_age_years",
                    "high_risk_transformers", "risk_score", "risk_tier", "recommendation_fr", "recommendation_en",
                    "lon", "lat")
            .orderBy(F.desc("risk_score"), "zone_id").limit(limit))


def transformer_panel(status: DataFrame, ced: str | None = None, line: str | None = None,
                      limit: int = 15) -> DataFrame:
    return (_of_centre(status, ced, line)
            .select("transformer_id", "line_id", "ced_code", "kva", "n_customers", "max_overload_pct_last_winter",
                    "risk_score_next_winter", "risk_tier", "lon", "lat")
            .orderBy(F.desc_nulls_last("risk_score_next_winter"), "transformer_id")
            .limit(limit))


def totals_strip(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
                         ("active_outages", "customers_out", "high_risk_transformers")])
