"""The landed entities as arithmetic views over the TPC-H-like test tables.

region -> operating centre, nation -> substation, supplier -> line and its three
protection devices, part -> pole and transformer, customer -> customer,
orders -> outage, lineitem -> daily load and weather. FIXTURES.md has the rules.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2001, 8, 2)
FEATURE_WINTER = 2000
LABEL_WINTER = 2001

POLES_PER_LINE = 20
STEP_DEG = 0.0008
_RATINGS = "25.0D, 37.5D, 50.0D, 75.0D, 100.0D, 167.0D"


def _pick(values: str, index: str) -> str:
    """The value at a 0-based index, as SQL."""
    return f"array({values})[CAST({index} AS INT)]"


_SUFFIX = "array('-T', '-L01', '-L02')[{0}]"


def _head_lon(nation: str) -> str:
    return f"(-78.0D + ({nation} % 5) * 4)"


def _head_lat(nation: str) -> str:
    return f"(45.5D + ({nation} div 5) * 3.0D)"


def _offset(along: str, branch: str, seq: str) -> str:
    """Grid offset on one axis: the trunk follows (dx,dy), laterals leave it at right angles."""
    ahead, aside = ("dx", "- dy") if along == "lon" else ("dy", "+ dx")
    return (f"CASE {branch} WHEN 0 THEN {ahead} * {seq} ELSE 3 * {branch} * {ahead} {aside} * {seq} END")


class MappedTables:
    """Lazy views; nothing is read until a query runs, except two row counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # the generator fixes twenty parts per supplier; footers answer the count
    @property
    def n_lines(self) -> int:
        if not hasattr(self, "_n_lines"):
            self._n_lines = self._read("supplier").count()
        return self._n_lines

    def entity(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def ced(self) -> DataFrame:
        west, east = "CAST(-79.5D + 4 * r_regionkey AS STRING)", "CAST(-76.5D + 4 * r_regionkey AS STRING)"
        corners = [(west, "44.2"), (east, "44.2"), (east, "62.5"), (west, "62.5"), (west, "44.2")]
        text = ", ', ', ".join(f"{lon}, ' {lat}'" for lon, lat in corners)
        return self._read("region").selectExpr(
            "concat('C', r_regionkey) AS ced_code", "concat('CED ', r_name) AS ced_name", "r_name AS region_name",
            "r_regionkey % 2 = 0 AS is_urban", f"concat('POLYGON((', {text}, '))') AS boundary_wkt")

    def substations(self) -> DataFrame:
        return self._read("nation").selectExpr(
            "n_name AS substation_code", "concat('POSTE ', n_name) AS substation_name",
            "concat('C', n_regionkey) AS ced_code", f"{_head_lon('n_nationkey')} AS lon",
            f"{_head_lat('n_nationkey')} AS lat", "20.0D + (n_nationkey % 4) * 10 AS capacity_mva")

    def lines(self) -> DataFrame:
        nations = self._read("nation").selectExpr("n_nationkey AS s_nationkey", "n_name", "n_regionkey")
        return self._read("supplier").join(nations, "s_nationkey").selectExpr(
            "s_name AS line_id", "n_name AS substation_code", "concat('C', n_regionkey) AS ced_code",
            "25 AS voltage_kv", "CAST(1958 + s_suppkey % 35 AS INT) AS commissioning_year",
            _pick("'ACSR', 'AAC', 'CU'", "s_suppkey % 3") + " AS conductor")

    def _suppliers(self) -> DataFrame:
        """Line heads with their direction, worked out on this short side of later joins."""
        return self._read("supplier").selectExpr(
            "s_suppkey", "s_name", _pick("1, 1, 0, -1, -1, -1, 0, 1", "s_suppkey % 8") + " AS dx",
            _pick("0, 1, 1, 1, 0, -1, -1, -1", "s_suppkey % 8") + " AS dy",
            f"{_head_lon('s_nationkey')} AS head_lon", f"{_head_lat('s_nationkey')} AS head_lat")

    def _positions(self) -> DataFrame:
        """part with its line, branch (0 trunk, 1 and 2 laterals), sequence and location."""
        parts = self._read("part").selectExpr(
            "p_partkey", "p_size", f"p_partkey % {self.n_lines} AS s_suppkey",
            f"CAST(p_partkey div {self.n_lines} AS INT) AS idx")
        return (parts.selectExpr("*", "if(idx < 10, 0, if(idx < 15, 1, 2)) AS branch",
                                 "if(idx < 10, idx + 1, if(idx < 15, idx - 9, idx - 14)) AS seq")
                .join(self._suppliers(), "s_suppkey")
                .selectExpr("*", f"head_lon + {STEP_DEG}D * {_offset('lon', 'branch', 'seq')} "
                                 "+ (p_partkey % 13) * 0.000003D AS lon",
                            f"head_lat + {STEP_DEG}D * {_offset('lat', 'branch', 'seq')} "
                            "+ (p_size % 7) * 0.00001D AS lat"))

    def poles(self) -> DataFrame:
        n = self.n_lines
        parent = (f"CASE WHEN idx = 0 THEN NULL WHEN idx = 10 THEN p_partkey - 8 * {n} "
                  f"WHEN idx = 15 THEN p_partkey - 10 * {n} ELSE p_partkey - {n} END")
        return self._positions().selectExpr(
            "concat('P', p_partkey) AS pole_id", "s_name AS line_id", f"concat(s_name, {_SUFFIX.format('branch')}) AS branch_id",
            "seq AS branch_seq", f"concat('P', {parent}) AS parent_pole_id", "lon", "lat",
            "CAST(1940 + (p_partkey * 7) % 80 AS INT) AS install_year",
            _pick("'CEDAR', 'PINE', 'STEEL'", "p_partkey % 3") + " AS material", "10.0D + p_size % 6 AS height_m")

    def transformers(self) -> DataFrame:
        return self._read("part").filter("p_partkey % 3 = 0").selectExpr(
            "concat('TX', p_partkey) AS transformer_id", "concat('P', p_partkey) AS pole_id",
            _pick(_RATINGS, "(p_partkey div 3) % 6") + " AS kva",
            "CAST(1958 + (p_partkey * 11) % 66 AS INT) AS install_year",
            _pick("'A', 'B', 'C'", "p_partkey % 9 div 3") + " AS phase", "p_brand AS manufacturer")

    def _devices(self) -> DataFrame:
        """Three devices per line: at the substation and at the first pole of each lateral."""
        suffix = _pick("'_DJ', '_F1', '_F2'", "b")
        at = {c: f"head_{c} + {STEP_DEG}D * {_offset(c, 'b', '1')}" for c in ("lon", "lat")}
        return (self._suppliers().selectExpr("*", "explode(array(0, 1, 2)) AS b")
                .selectExpr("s_suppkey", "s_name", "b", f"s_suppkey + b * {self.n_lines} AS di",
                            f"concat(s_name, {suffix}) AS device_id",
                            *[f"if(b = 0, head_{c}, {e}) AS {c}" for c, e in at.items()],
                            *[f"{e} AS fault_{c}" for c, e in at.items()]))

    def protection_devices(self) -> DataFrame:
        n = self.n_lines
        return self._devices().selectExpr(
            "device_id", "CASE WHEN b = 0 THEN 'DISJONCTEUR' ELSE 'COUPE-CIRCUIT' END AS device_type",
            "s_name AS line_id", f"concat(s_name, {_SUFFIX.format('b')}) AS protected_branch_id",
            f"concat('P', CASE b WHEN 1 THEN s_suppkey + 10 * {n} WHEN 2 THEN s_suppkey + 15 * {n} END) AS pole_id",
            "lon", "lat", _pick("600, 65, 100", "b") + " AS rating_a",
            "CAST(1970 + s_suppkey % 50 AS INT) AS install_year")

    def customers(self) -> DataFrame:
        k = f"(c_custkey * 7) % {POLES_PER_LINE * self.n_lines}"
        at = self._positions().selectExpr("p_partkey AS k", "lon", "lat")
        offset = "((c_custkey % 11) - 5) * 0.00005D"
        return self._read("customer").selectExpr("*", f"{k} - ({k}) % 3 AS k").join(at, "k").selectExpr(
            "concat('CU', c_custkey) AS customer_id", "concat('TX', k) AS transformer_id", "c_name AS customer_name",
            "concat(c_custkey, ' rue Principale') AS address", "concat('MUN-', c_nationkey) AS municipality",
            f"lon + {offset} AS lon", f"lat + {offset} AS lat", "c_mktsegment AS customer_type",
            "c_custkey % 4 <> 0 AS electric_heating", "5.0D + c_custkey % 20 AS contract_kw")

    def outages(self) -> DataFrame:
        start = "unix_timestamp(o_orderdate) + (o_orderkey % 1440) * 60"
        ongoing = "o_orderstatus = 'P' AND o_orderdate >= timestamp'2001-07-01'"
        at = self._devices().select("di", "device_id", "fault_lon", "fault_lat")
        return (self._read("orders")
                .selectExpr("*", f"(o_orderkey * 13) % {3 * self.n_lines} AS di", f"{start} AS started",
                            "floor(o_totalprice) % 720 + 5 AS minutes")
                .join(at, "di").selectExpr(
                    "concat('OUT', o_orderkey) AS outage_id", "device_id", "timestamp_seconds(started) AS start_ts",
                    f"CASE WHEN NOT ({ongoing}) THEN timestamp_seconds(started + minutes * 60) END AS end_ts",
                    "o_orderpriority AS cause", "CAST(1 + o_custkey % 200 AS INT) AS customers_interrupted",
                    "fault_lon", "fault_lat"))

    def transformer_load(self) -> DataFrame:
        peak = "l_quantity * (1 + l_linenumber) / 2.0D"
        return self._read("lineitem").selectExpr(
            "concat('TX', l_partkey - l_partkey % 3) AS transformer_id", "to_date(l_shipdate) AS reading_date",
            f"{peak} AS peak_kva", f"12.0D * ({peak}) AS energy_kwh")

    def weather(self) -> DataFrame:
        regions = self._read("region").count()
        days = self._read("lineitem").selectExpr("to_date(l_shipdate) AS date").distinct()
        low = "CAST((dayofyear(date) * 37 + r * 11) % 46 - 30 AS DOUBLE)"
        return (days.filter("dayofmonth(date) <> 13")
                .selectExpr("date", f"explode(sequence(0, {regions - 1})) AS r")
                .selectExpr("date", "concat('C', r) AS ced_code", f"{low} AS temp_min_c", f"{low} + 8 AS temp_max_c"))
