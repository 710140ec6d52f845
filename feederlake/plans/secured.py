"""What a caller may see: filtered rows, masked text, coarser customer locations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.hexgrid import EDGE_M
from feederlake.operators.access import Caller, masked_place, masked_text, row_filter
from feederlake.plans.network import Network

ROW_FILTERED = ("gold.customers_pii", "gold.outages")
#: What anybody may ask for; everything else, silver and bronze above all, is refused.
READABLE = frozenset({
    "gold.operating_centers", "gold.substations", "gold.lines", "gold.line_areas", "gold.line_shapes", "gold.line_bounds",
    "gold.poles", "gold.spans", "gold.protection_devices", "gold.transformers", "gold.transformer_load_daily",
    "gold.outages", "gold.zone_summary", "gold.zone_shapes", "gold.protection_zones", "gold.chi_hex",
    "gold.transformer_risk", "gold.zone_risk", "gold.zone_risk_recommendations", "gold.ops_transformer_status",
    "gold.ops_zone_risk", "gold.ops_active_outages", "gold.ops_line_status",
})
METRES_PER_DEGREE = 110_500.0  # of latitude, at least
MASKED_TEXT = ("customer_name", "address")


class SecuredView:
    """Tables of a network as one caller sees them.

    Gold itself is always built from unfiltered tables; filters bind on reading.
    """

    def __init__(self, net: Network, caller: Caller, access: DataFrame):
        self.net = net
        self.caller = caller
        self.access = access

    def table(self, name: str) -> DataFrame:
        """A table by name. Exact customer rows are for readers of personal data; others ask for gold.customers."""
        if name == "gold.customers":
            return self._customers()
        if name not in READABLE and not (name == "gold.customers_pii" and self.caller.reads_pii):
            raise PermissionError(f"{self.caller.principal} may not read {name}")
        return self._filtered(name)

    def _filtered(self, name: str) -> DataFrame:
        df = self.net.table(name)
        if name in ROW_FILTERED:
            df = row_filter(df, self.caller, self.access)
        if name == "gold.customers_pii":
            df = df.withColumns({c: masked_text(F.col(c), self.caller) for c in MASKED_TEXT})
        return df

    def customer_places(self, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """Places (lon, lat, x, y) with the number n of customers shown there.

        Masked customers of a cell share one place, so they are counted per cell first. With a box (west, south, east,
        north) at least the places in it are there; the scan skips customers farther from it than their cell reaches.
        """
        df = self._filtered("gold.customers_pii")
        if box is not None:
            west, south, east, north = box
            reach = 0.0 if self.caller.reads_pii else 1.1 * EDGE_M[8] / METRES_PER_DEGREE
            wide = reach / math.cos(math.radians(min(89.0, max(abs(south), abs(north)) + reach)))
            df = df.filter(F.col("lon").between(west - wide, east + wide) & F.col("lat").between(south - reach, north + reach))
        if self.caller.reads_pii:
            return df.select("lon", "lat", "x", "y", F.lit(1).alias("n"))
        cells = df.groupBy("hex_cell_8").agg(F.count(F.lit(1)).alias("n"))
        return masked_place(cells, self.caller)

    def _customers(self) -> DataFrame:
        """Customers with the exact point for readers of personal data, the cell centre otherwise."""
        return masked_place(self._filtered("gold.customers_pii"), self.caller)
