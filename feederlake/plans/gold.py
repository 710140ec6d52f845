"""Gold: network assets, loads, outages and protection zones, ready to query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feederlake.functions.calendar import since_months, winter_name
from feederlake.functions.hexgrid import cell_ring
from feederlake.functions.projection import ring_degrees
from feederlake.functions.shapes import distance, planar_ring_area, polygon_area_m2, ring_centroid
from feederlake.operators.corridor import corridor_area, corridor_ring
from feederlake.operators.hulls import hull_rings
from feederlake.operators.running import running_sum
from feederlake.plans.network import Network, product
from feederlake.schemas import (
    BREAKER,
    CUTOUT,
    LATERAL,
    OVERLOAD_PCT,
    RIGHT_OF_WAY_M,
    TRUNK,
    TRUNK_SUFFIX,
    ZONE_MARGIN_M,
)

#: Places along a branch whose spans are kept together; one grain for short and long lines.
BLOCK_SPANS = 1000


# ---------------------------------------------------------------- reference

@product("gold.operating_centers")
def operating_centers(net: Network) -> DataFrame:
    return net.table("silver.operating_centers").select(
        "ced_code", "ced_name", "region_name", "is_urban",
        F.expr(f"{polygon_area_m2('rings')} / 1e6D").alias("area_km2"), "rings")


@product("gold.substations")
def substations(net: Network) -> DataFrame:
    return net.table("silver.substations").join(_regions(net), "ced_code").select(
        "substation_code", "substation_name", "ced_code", "region_name", "capacity_mva", "lon", "lat", "x", "y")


def _regions(net: Network) -> DataFrame:
    return net.table("silver.operating_centers").select("ced_code", "region_name")


def _line_regions(net: Network) -> DataFrame:
    """Line with its centre; joined once here, so a big table meets one small one."""
    return (net.table("silver.lines").select("line_id", "substation_code", "ced_code")
            .join(_regions(net), "ced_code"))


def _line_feeds(net: Network) -> DataFrame:
    """The same, with the feeding substation and its place."""
    heads = net.table("silver.substations").select(
        "substation_code", "substation_name", F.col("x").alias("sub_x"), F.col("y").alias("sub_y"))
    return _line_regions(net).join(heads, "substation_code")


# ---------------------------------------------------------------- network

@product("gold.poles")
def poles(net: Network) -> DataFrame:
    lengths = net.shared("silver.spans").select(F.col("to_pole_id").alias("pole_id"), "length_m")
    base = net.shared("silver.poles").join(lengths, "pole_id")
    along = running_sum(base, "branch_id", "branch_seq", "length_m", "in_branch_m")
    is_trunk = F.col("branch_id").endswith(TRUNK_SUFFIX)

    trunk = along.filter(is_trunk).select(
        F.col("pole_id").alias("tap_id"), F.col("in_branch_m").alias("offset_m"))
    # the trunk pole a lateral is tapped from; the lateral's own span does not matter
    taps = (net.shared("silver.poles").filter(~is_trunk & (F.col("branch_seq") == 1))
            .select("branch_id", F.col("parent_pole_id").alias("tap_id")))
    offsets = taps.join(trunk, "tap_id").select("branch_id", "offset_m")

    df = along.join(_line_feeds(net), "line_id").join(offsets, "branch_id", "left")
    return df.select(
        "pole_id", "line_id", "substation_code", "substation_name", "ced_code", "region_name", "branch_id",
        F.when(is_trunk, TRUNK).otherwise(LATERAL).alias("branch_type"), "branch_seq", "parent_pole_id",
        "install_year", "age_years", "material", "height_m",
        F.expr(distance("x", "y", "sub_x", "sub_y")).alias("distance_to_substation_m"),
        (F.col("in_branch_m") + F.coalesce("offset_m", F.lit(0.0))).alias("network_distance_m"),
        "hex_cell_9", "lon", "lat", "x", "y", "sub_x", "sub_y")


@product("gold.spans")
def spans(net: Network) -> DataFrame:
    return net.shared("silver.spans").join(_line_regions(net), "line_id").select(
        "span_id", "line_id", "substation_code", "ced_code", "region_name", "branch_id", "from_node_id",
        "to_pole_id", F.round("length_m", 1).alias("length_m"),
        "lon1", "lat1", "lon2", "lat2", "x1", "y1", "x2", "y2")


def _customers_per_transformer(net: Network) -> DataFrame:
    return net.once("customers-per-transformer", lambda: net.table("silver.customers").groupBy("transformer_id").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.col("electric_heating").cast("int")).alias("electric_heating_share")))


def _downstream(net: Network, key: str) -> DataFrame:
    """Transformers and customers per branch or line; counted per transformer first."""
    per_tx = _customers_per_transformer(net).select("transformer_id", "n_customers")
    return (net.shared("silver.transformers").select("transformer_id", key)
            .join(per_tx, "transformer_id", "left")
            .groupBy(key).agg(F.count(F.lit(1)).alias("n_transformers"), F.sum("n_customers").alias("n_customers")))


@product("gold.protection_devices")
def protection_devices(net: Network) -> DataFrame:
    by_branch = _downstream(net, "branch_id").select(
        F.col("branch_id").alias("protected_branch_id"), F.col("n_customers").alias("branch_customers"),
        F.col("n_transformers").alias("branch_transformers"))
    by_line = _downstream(net, "line_id").select(
        "line_id", F.col("n_customers").alias("line_customers"), F.col("n_transformers").alias("line_transformers"))
    whole_line = F.col("device_type") == BREAKER
    return (net.table("silver.protection_devices")
            .join(_line_regions(net), "line_id")
            .join(by_branch, "protected_branch_id", "left")
            .join(by_line, "line_id", "left")
            .select("device_id", "device_type", "line_id", "substation_code", "ced_code", "region_name",
                    "protected_branch_id", "pole_id", "rating_a", "install_year",
                    F.when(whole_line, F.col("line_customers")).otherwise(F.col("branch_customers"))
                    .alias("customers_downstream"),
                    F.when(whole_line, F.col("line_transformers")).otherwise(F.col("branch_transformers"))
                    .alias("transformers_downstream"),
                    "lon", "lat"))


def _branch_zone(net: Network) -> DataFrame:
    """The device that protects each branch; of several the first by id, so that no asset is counted twice."""
    return net.table("silver.protection_devices").groupBy(F.col("protected_branch_id").alias("branch_id")).agg(
        F.min("device_id").alias("zone_id"))


def _transformer_sites(net: Network) -> DataFrame:
    """Transformer with its pole, feeder and zone."""
    at = net.shared("gold.poles").select(
        "pole_id", F.col("line_id").alias("pole_line_id"), "substation_code", "substation_name", "ced_code",
        "region_name", "distance_to_substation_m", "network_distance_m", F.col("x").alias("pole_x"),
        F.col("y").alias("pole_y"), "sub_x", "sub_y")
    return net.shared("silver.transformers").join(at, "pole_id").join(_branch_zone(net), "branch_id")


@product("gold.customers_pii")
def customers_pii(net: Network) -> DataFrame:
    sites = _transformer_sites(net).select(
        "transformer_id", "pole_id", F.col("pole_line_id").alias("line_id"), "substation_code", "substation_name",
        "ced_code", "region_name", "zone_id", "network_distance_m", "pole_x", "pole_y", "sub_x", "sub_y")
    return net.table("silver.customers").join(sites, "transformer_id").select(
        "customer_id", "customer_name", "address", "municipality", "customer_type", "electric_heating",
        "contract_kw", "transformer_id", "pole_id", "line_id", "substation_code", "substation_name", "ced_code",
        "region_name", "zone_id",
        F.expr(distance("x", "y", "sub_x", "sub_y")).alias("distance_to_substation_m"),
        F.expr(f"network_distance_m + {distance('x', 'y', 'pole_x', 'pole_y')}").alias("network_distance_m"),
        "hex_cell_8", "lon", "lat", "x", "y")


# ---------------------------------------------------------------- lines

@product("gold.line_areas")
def line_areas(net: Network) -> DataFrame:
    return corridor_area(net.table("silver.spans"), "line_id", RIGHT_OF_WAY_M)


@product("gold.lines")
def lines(net: Network) -> DataFrame:
    strung = net.shared("silver.spans").groupBy("line_id").agg(
        F.sum("length_m").alias("total_m"), F.count(F.lit(1)).alias("n_spans"))
    posts = net.shared("gold.poles").groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_poles"), F.max("distance_to_substation_m").alias("far_m"),
        F.max("network_distance_m").alias("far_net_m"), F.avg("age_years").alias("age"))
    feeds = _line_feeds(net).drop("sub_x", "sub_y", "substation_code", "ced_code")
    return (net.table("silver.lines")
            .join(strung, "line_id").join(posts, "line_id").join(feeds, "line_id")
            .join(_downstream(net, "line_id"), "line_id", "left")
            .join(net.table("gold.line_areas"), "line_id", "left")
            .select("line_id", "substation_code", "substation_name", "ced_code", "region_name", "voltage_kv",
                    "commissioning_year", "conductor", F.round(F.col("total_m") / 1000, 2).alias("length_km"),
                    "n_spans", "n_poles", "n_transformers", "n_customers",
                    F.round("far_m", 0).alias("max_distance_to_substation_m"),
                    F.round("far_net_m", 0).alias("max_network_distance_m"),
                    F.round("age", 1).alias("avg_pole_age_years"),
                    F.lit(RIGHT_OF_WAY_M).alias("right_of_way_half_width_m"),
                    F.round("area_m2", 0).alias("right_of_way_area_m2")))


@product("gold.line_shapes")
def line_shapes(net: Network) -> DataFrame:
    """All spans of a line as point pairs, and their right-of-way rings, per block of a branch."""
    block = F.expr(f"(branch_seq - 1) div {BLOCK_SPANS}").cast("string")
    pieces = net.table("silver.spans").withColumn("part", F.concat_ws("#", "branch_id", block))
    start = F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))
    end = F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat"))
    outline = F.expr(ring_degrees(corridor_ring(RIGHT_OF_WAY_M)))
    ordered = F.array_sort(F.collect_list(F.struct(
        "branch_id", "branch_seq", "span_id", F.array(start, end).alias("path"), outline.alias("outline"))))
    return (pieces.groupBy("line_id", "part").agg(ordered.alias("s"))
            .select("line_id", "part", F.col("s.path").alias("paths"), F.col("s.outline").alias("outlines")))


@product("gold.line_bounds")
def line_bounds(net: Network) -> DataFrame:
    return net.table("silver.spans").groupBy("line_id").agg(
        F.min(F.least("lon1", "lon2")).alias("xmin"), F.min(F.least("lat1", "lat2")).alias("ymin"),
        F.max(F.greatest("lon1", "lon2")).alias("xmax"), F.max(F.greatest("lat1", "lat2")).alias("ymax"))


# ---------------------------------------------------------------- load

def _winter_columns(net: Network) -> list[Column]:
    columns = []
    for year in net.settings.winters:
        season = F.col("winter_label") == winter_name(year)
        over = F.col("overload_pct") > OVERLOAD_PCT
        columns.append(F.max(F.when(season, F.col("overload_pct"))).alias(f"max_overload_pct_hiver_{year}"))
        columns.append(F.count_if(season & over).alias(f"days_over_150_hiver_{year}"))
    return columns


@product("gold.transformers")
def transformers(net: Network) -> DataFrame:
    # the per-transformer season summary needs no reading outside the two winters,
    # but a transformer with readings elsewhere still counts zero days, not NULL
    winters = net.table("silver.transformer_load_daily").groupBy("transformer_id").agg(*_winter_columns(net))
    first, second = net.settings.winters
    return (_transformer_sites(net)
            .join(winters, "transformer_id", "left")
            .join(_customers_per_transformer(net), "transformer_id", "left")
            .select("transformer_id", "pole_id", "line_id", "substation_code", "ced_code", "region_name", "zone_id",
                    "kva", "install_year", "age_years", "phase", "manufacturer",
                    F.coalesce("n_customers", F.lit(0)).alias("n_customers"),
                    F.round("electric_heating_share", 2).alias("electric_heating_share"),
                    f"max_overload_pct_hiver_{first}", f"max_overload_pct_hiver_{second}",
                    f"days_over_150_hiver_{first}", f"days_over_150_hiver_{second}",
                    "distance_to_substation_m", "hex_cell_9", "lon", "lat"))


def transformer_profile(net: Network) -> DataFrame:
    """Identity, rating and customers per transformer, without the season summary."""
    if net.store is not None and net.store.exists("gold.transformers"):
        return net.table("gold.transformers")
    return net.once("transformer-profile", lambda: (
        _transformer_sites(net).join(_customers_per_transformer(net), "transformer_id", "left")
        .withColumns({"n_customers": F.coalesce("n_customers", F.lit(0)),
                      "electric_heating_share": F.round("electric_heating_share", 2)})))


@product("gold.transformer_load_daily")
def transformer_load_daily(net: Network) -> DataFrame:
    # only identity and rating are needed here, not the season summary
    sites = _transformer_sites(net).select("transformer_id", "ced_code", "kva")
    frost = net.table("silver.weather_daily").select(
        F.col("weather_date").alias("reading_date"), "ced_code", "temp_min_c")
    return (net.table("silver.transformer_load_daily").join(sites, "transformer_id")
            .join(frost, ["ced_code", "reading_date"], "left")
            .select("transformer_id", "line_id", "ced_code", "reading_date", "winter_label", "peak_kva", "kva",
                    "overload_pct", "energy_kwh", "temp_min_c"))


# ---------------------------------------------------------------- outages

@product("gold.outages")
def outages(net: Network) -> DataFrame:
    where = (net.table("silver.protection_devices").select("device_id", "device_type", "line_id")
             .join(_line_regions(net), "line_id"))
    hours = F.col("duration_h").cast("decimal(27,6)")
    chi = F.round(F.col("customers_interrupted").cast("decimal(10,0)") * hours, 1)
    return net.table("silver.outages").join(where, "device_id").select(
        "outage_id", F.col("device_id").alias("zone_id"), "device_type", "line_id", "substation_code", "ced_code",
        "region_name", "start_ts", "end_ts", "is_ongoing", "cause", "customers_interrupted",
        F.round(hours, 2).cast("double").alias("duration_h"), chi.cast("double").alias("chi"),
        "fault_lon", "fault_lat")


def _zone_kpis(net: Network) -> DataFrame:
    as_of = net.settings.as_of
    last3 = since_months(F.col("start_ts"), as_of, 3)
    last6 = since_months(F.col("start_ts"), as_of, 6)

    def chi_if(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("chi")).otherwise(F.lit(0.0))).alias(name)

    return net.table("gold.outages").groupBy("zone_id").agg(
        F.count_if(last3).alias("interruptions_3m"), F.count_if(last6).alias("interruptions_6m"),
        chi_if(last6, "chi_6m"), chi_if(last3, "chi_3m"), chi_if(last6 & ~last3, "chi_prev_3m"),
        F.sum("chi").alias("chi_24m"))


def _pole_counts(net: Network) -> DataFrame:
    """Poles and their ages per zone: branch poles for a cutout, line poles for a breaker.

    Counted per branch and per line first, so each arm joins a short table by equality.
    """
    devices = net.table("silver.protection_devices").select("device_id", "device_type", "line_id",
                                                            "protected_branch_id")
    # a pole counts when it is in the gold table: located, on a span, on a known line
    per_branch = net.shared("gold.poles").groupBy("line_id", "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("age_years").alias("ages"))
    cutouts = (devices.filter(F.col("device_type") == CUTOUT)
               .join(per_branch.drop("line_id"), F.col("protected_branch_id") == F.col("branch_id"))
               .select("device_id", "n", "ages"))
    per_line = per_branch.groupBy("line_id").agg(F.sum("n").alias("n"), F.sum("ages").alias("ages"))
    breakers = (devices.filter(F.col("device_type") == BREAKER).join(per_line, "line_id")
                .select("device_id", "n", "ages"))
    return (cutouts.unionByName(breakers).groupBy(F.col("device_id").alias("zone_id"))
            .agg(F.sum("n").alias("n_poles"), (F.sum("ages") / F.sum("n")).alias("age")))


@product("gold.zone_summary")
def zone_summary(net: Network) -> DataFrame:
    """Everything about a protection zone but its outline."""
    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    def tenth(name: str) -> Column:
        return F.round(F.coalesce(name, F.lit(0.0)), 1).alias(name)

    devices = net.table("gold.protection_devices").withColumnRenamed("device_id", "zone_id")
    return (devices.join(_pole_counts(net), "zone_id").join(_zone_kpis(net), "zone_id", "left")
            .select("zone_id", "device_type", "line_id", "substation_code", "ced_code", "region_name",
                    F.col("customers_downstream").alias("n_customers"), "n_poles",
                    F.round("age", 1).alias("avg_pole_age_years"),
                    or_zero("interruptions_3m"), or_zero("interruptions_6m"),
                    tenth("chi_3m"), tenth("chi_prev_3m"), tenth("chi_6m"), tenth("chi_24m")))


def zone_outlines(net: Network, only: DataFrame | None = None) -> DataFrame:
    """Outline, area and centroid per zone: hull of its poles, widened.

    With ``only`` (a table of zone_id) the hulls of other zones are never computed.
    """
    if only is not None and net.store is not None and net.store.exists("gold.zone_shapes"):
        return net.table("gold.zone_shapes").join(only.select("zone_id").distinct(), "zone_id", "left_semi")
    devices = net.table("silver.protection_devices").select(
        F.col("device_id").alias("zone_id"), "device_type", "line_id", "protected_branch_id")
    if only is not None:
        devices = devices.join(only.select("zone_id").distinct(), "zone_id", "left_semi")
    points = net.shared("gold.poles").select("line_id", "branch_id", "x", "y")
    cutouts = devices.filter(F.col("device_type") == CUTOUT).select(
        F.col("protected_branch_id").alias("branch_id"), F.col("zone_id").alias("cutout"))
    breakers = devices.filter(F.col("device_type") == BREAKER).select("line_id", F.col("zone_id").alias("breaker"))
    placed = (points.join(cutouts, "branch_id", "left").join(breakers, "line_id", "left")
              .select(F.explode(F.array("cutout", "breaker")).alias("zone_id"), "x", "y")
              .filter("zone_id is not null"))
    rings = hull_rings(placed, "zone_id", ZONE_MARGIN_M)
    shaped = rings.select(
        "zone_id", F.expr(f"round({planar_ring_area('ring')} / 1e6D, 3)").alias("zone_area_km2"),
        F.expr(ring_degrees("ring")).alias("zone_ring"))
    return (shaped.selectExpr("*", f"{ring_centroid('zone_ring')} AS centre")
            .selectExpr("zone_id", "zone_area_km2", "centre.lon AS centroid_lon", "centre.lat AS centroid_lat",
                        "zone_ring"))


@product("gold.zone_shapes")
def zone_shapes(net: Network) -> DataFrame:
    return zone_outlines(net)


@product("gold.protection_zones")
def protection_zones(net: Network) -> DataFrame:
    return net.table("gold.zone_summary").join(net.table("gold.zone_shapes"), "zone_id")


@product("gold.chi_hex")
def chi_hex(net: Network) -> DataFrame:
    """Customer hours of the last six months, spread over cells by customer share."""
    recent = (net.table("gold.outages").filter(since_months(F.col("start_ts"), net.settings.as_of, 6))
              .groupBy("zone_id").agg(F.sum("chi").alias("zone_chi")))
    homes = net.table("gold.customers_pii").groupBy("zone_id", "line_id", "hex_cell_8", "ced_code").agg(
        F.count(F.lit(1)).alias("n"))
    breakers = net.table("silver.protection_devices").filter(F.col("device_type") == BREAKER).select(
        "line_id", F.col("device_id").alias("breaker_id"))
    whole_line = (homes.join(breakers, "line_id").filter(F.col("zone_id") != F.col("breaker_id"))
                  .select(F.col("breaker_id").alias("zone_id"), "hex_cell_8", "ced_code", "n"))
    shares = (homes.select("zone_id", "hex_cell_8", "ced_code", "n").unionByName(whole_line)
              .groupBy("zone_id", "hex_cell_8", "ced_code").agg(F.sum("n").alias("n")))
    totals = shares.groupBy("zone_id").agg(F.sum("n").alias("n_tot"))
    return (shares.join(recent.join(totals, "zone_id"), "zone_id")
            .groupBy("hex_cell_8", "ced_code")
            .agg(F.expr("round(round(sum(zone_chi * n / n_tot), 6), 1)").alias("chi_6m"),
                 F.count(F.lit(1)).alias("zones_impacted"))
            .withColumn("cell_ring", F.expr(cell_ring("hex_cell_8"))))
