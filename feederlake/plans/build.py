"""A refresh: every product computed once, in order, and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame

from feederlake.operators.access import with_comments
from feederlake.operators.snapshot import KeyedTable
from feederlake.plans import gold, ops, risk, silver  # noqa: F401  (registers the products)
from feederlake.plans.comments import COMMENTS
from feederlake.plans.network import PRODUCTS, Network
from feederlake.plans.ops import KEYS, VOLATILE

STORED = [
    *[f"silver.{n}" for n in (
        "operating_centers", "substations", "lines", "poles", "spans", "transformers", "protection_devices",
        "customers", "outages", "weather_daily", "transformer_load_daily")],
    *[f"gold.{n}" for n in (
        "operating_centers", "substations", "poles", "spans", "protection_devices", "customers_pii", "line_areas",
        "lines", "line_shapes", "line_bounds", "transformers", "transformer_load_daily", "outages", "zone_summary", "zone_shapes",
        "protection_zones", "chi_hex", "transformer_risk", "zone_risk", "zone_risk_recommendations")],
]


def refresh(net: Network) -> dict[str, int]:
    """Recompute all products into the network's store, then merge the operational tables.

    With ``net.count_violations`` the quality counters of each silver table are in
    ``net.observations`` afterwards; they are collected by the writes themselves.
    """
    if net.store is None:
        raise ValueError("a refresh needs a table store")
    written = {}
    for name in STORED:
        fresh: DataFrame = with_comments(PRODUCTS[name](net), COMMENTS.get(name, {}))
        written[name] = net.store.replace(name, fresh)
        net.forget(name)
    for name, key in KEYS.items():
        KeyedTable(net.store, name, key, VOLATILE).merge(PRODUCTS[name](net))
        net.forget(name)
        written[name] = net.store.version(name)
    return written
