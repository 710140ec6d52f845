"""Silver: typed, deduplicated entities with locations and network topology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.calendar import winter_label
from feederlake.functions.hexgrid import cell_id
from feederlake.functions.projection import with_metres
from feederlake.functions.shapes import distance, rings_from_wkt, rings_well_formed
from feederlake.operators.quality import DROP, FAIL, WARN, Rule
from feederlake.operators.spatial import edges_apart
from feederlake.plans.network import Network, product

# The coordinate box of the territory.
_IN_BOX = "lon BETWEEN -80 AND -57 AND lat BETWEEN 44 AND 63"


def rules_for(net: Network) -> dict[str, list[Rule]]:
    """The quality rules per silver table."""
    located = Rule("valid_coords", _IN_BOX, DROP)
    return {
        "operating_centers": [Rule("valid_polygon", "_valid", FAIL)],
        "substations": [located],
        "poles": [located, Rule("plausible_install_year",
                                f"install_year BETWEEN 1940 AND {net.settings.year}", WARN)],
        "spans": [Rule("positive_length", "length_m > 0", DROP)],
        "transformers": [Rule("has_pole", "pole_id IS NOT NULL", DROP), Rule("valid_kva", "kva > 0", WARN)],
        "protection_devices": [located],
        "customers": [located, Rule("has_transformer", "transformer_id IS NOT NULL", DROP)],
        "outages": [Rule("valid_customers", "customers_interrupted > 0", DROP),
                    Rule("end_after_start", "end_ts IS NULL OR end_ts >= start_ts", WARN)],
        "transformer_load_daily": [Rule("positive_peak", "peak_kva >= 0", DROP)],
    }


def unchecked(net: Network, name: str) -> DataFrame:
    """A silver table before its quality rules."""
    return _SHAPED[name](net)


def _checked(net: Network, name: str) -> DataFrame:
    df = net.checked(name, unchecked(net, name), rules_for(net).get(name, []))
    return df.drop("_valid")


def _operating_centers(net: Network) -> DataFrame:
    sound = f"CASE WHEN {rings_well_formed('rings')} THEN {edges_apart('rings')} ELSE false END"
    return (net.latest("ced")
            .selectExpr("ced_code", "ced_name", "region_name", "CAST(is_urban AS BOOLEAN) AS is_urban",
                        f"{rings_from_wkt('boundary_wkt')} AS rings")
            .selectExpr("*", f"{sound} AS _valid"))


def _substations(net: Network) -> DataFrame:
    return with_metres(net.latest("substations").select(
        "substation_code", "substation_name", "ced_code", F.col("capacity_mva").cast("double").alias("capacity_mva"),
        "lon", "lat"))


def _lines(net: Network) -> DataFrame:
    return net.latest("lines").select(
        "line_id", "substation_code", "ced_code", F.col("voltage_kv").cast("int").alias("voltage_kv"),
        F.col("commissioning_year").cast("int").alias("commissioning_year"), "conductor")


def _poles(net: Network) -> DataFrame:
    df = with_metres(net.latest("poles"))
    return df.select(
        "pole_id", "line_id", "branch_id", "branch_seq", "parent_pole_id", "install_year",
        net.age("install_year").alias("age_years"), "material", F.col("height_m").cast("double").alias("height_m"),
        "lon", "lat", "x", "y", F.expr(cell_id("x", "y", 9)).alias("hex_cell_9"))


def _spans(net: Network) -> DataFrame:
    child = net.shared("silver.poles").select("pole_id", "line_id", "branch_id", "branch_seq", "parent_pole_id",
                                             "lon", "lat", "x", "y")
    place = ("lon", "lat", "x", "y")
    parent = net.shared("silver.poles").select(
        F.col("pole_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in place])
    feeds = net.table("silver.lines").select("line_id", "substation_code")
    heads = net.table("silver.substations").select(
        F.col("substation_code").alias("head_code"), *[F.col(c).alias(f"s_{c}") for c in place])
    df = (child
          .join(parent, child["parent_pole_id"] == parent["parent_id"], "left")
          .join(feeds, "line_id", "left")
          .join(heads, (F.col("substation_code") == F.col("head_code")) & F.col("parent_pole_id").isNull(), "left"))
    # a pole's span starts at its parent, or at the substation when it has none
    joined = df.selectExpr(
        "concat('S-', pole_id) AS span_id", "line_id", "branch_id", "branch_seq",
        "coalesce(parent_id, head_code) AS from_node_id", "pole_id AS to_pole_id",
        "coalesce(p_lon, s_lon) AS lon1", "coalesce(p_lat, s_lat) AS lat1", "lon AS lon2", "lat AS lat2",
        "coalesce(p_x, s_x) AS x1", "coalesce(p_y, s_y) AS y1", "x AS x2", "y AS y2")
    return joined.selectExpr("*", f"{distance('x1', 'y1', 'x2', 'y2')} AS length_m")


def _transformers(net: Network) -> DataFrame:
    at = net.shared("silver.poles").select("pole_id", "line_id", "branch_id", "lon", "lat", "x", "y", "hex_cell_9")
    return net.latest("transformers").join(at, "pole_id", "left").select(
        "transformer_id", "pole_id", "line_id", "branch_id", "kva", "install_year",
        net.age("install_year").alias("age_years"), "phase", "manufacturer", "lon", "lat", "x", "y", "hex_cell_9")


def _protection_devices(net: Network) -> DataFrame:
    return net.latest("protection_devices").select(
        "device_id", "device_type", "line_id", "protected_branch_id", "pole_id",
        F.col("rating_a").cast("int").alias("rating_a"), F.col("install_year").cast("int").alias("install_year"),
        "lon", "lat")


def _customers(net: Network) -> DataFrame:
    df = with_metres(net.latest("customers"))
    return df.select(
        "customer_id", "transformer_id", "customer_name", "address", "municipality", "customer_type",
        "electric_heating", F.col("contract_kw").cast("double").alias("contract_kw"), "lon", "lat", "x", "y",
        F.expr(cell_id("x", "y", 8)).alias("hex_cell_8"))


def _outages(net: Network) -> DataFrame:
    df = net.latest("outages").withColumns({
        "start_ts": F.col("start_ts").cast("timestamp"), "end_ts": F.col("end_ts").cast("timestamp")})
    seconds = F.unix_timestamp(F.coalesce("end_ts", net.settings.now())) - F.unix_timestamp("start_ts")
    # exact to the sixth decimal, half up: the hours keep no binary noise
    hours = (seconds.cast("decimal(20,0)") / F.lit(3600).cast("decimal(5,1)")).cast("decimal(27,6)")
    return df.select(
        "outage_id", "device_id", "start_ts", "end_ts", F.col("end_ts").isNull().alias("is_ongoing"), "cause",
        F.col("customers_interrupted").cast("int").alias("customers_interrupted"),
        hours.cast("double").alias("duration_h"), "fault_lon", "fault_lat")


def _weather_daily(net: Network) -> DataFrame:
    return net.latest("weather").select(F.col("date").alias("weather_date"), "ced_code", "temp_min_c", "temp_max_c")


def _transformer_load_daily(net: Network) -> DataFrame:
    rated = net.shared("silver.transformers").select("transformer_id", "kva", "line_id")
    day = F.col("reading_date").cast("date")
    return net.extract("transformer_load").join(rated, "transformer_id").select(
        "transformer_id", "line_id", day.alias("reading_date"), "peak_kva", "energy_kwh",
        F.round(F.try_divide(F.lit(100.0) * F.col("peak_kva"), F.col("kva")), 1).alias("overload_pct"),
        winter_label(day).alias("winter_label"))


_SHAPED = {
    "operating_centers": _operating_centers,
    "substations": _substations,
    "lines": _lines,
    "poles": _poles,
    "spans": _spans,
    "transformers": _transformers,
    "protection_devices": _protection_devices,
    "customers": _customers,
    "outages": _outages,
    "weather_daily": _weather_daily,
    "transformer_load_daily": _transformer_load_daily,
}

for _name in _SHAPED:
    product(f"silver.{_name}")(lambda net, _n=_name: _checked(net, _n))
