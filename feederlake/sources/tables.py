"""Tables kept as versioned Parquet folders.

A version is complete once its _SUCCESS marker exists, so readers never see a
half-written one, and a failed write is simply written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederlake.functions.curve import place_number

# physical order per table: the filter columns, then the key, so that a very
# common filter value is spread over several files
CLUSTERING: dict[str, tuple[str, ...]] = {
    "silver.poles": ("line_id", "pole_id"),
    "silver.spans": ("line_id", "span_id"),
    "silver.customers": ("transformer_id", "customer_id"),
    "silver.transformer_load_daily": ("transformer_id", "reading_date"),
    "gold.transformer_load_daily": ("transformer_id", "reading_date"),
    "gold.outages": ("start_ts", "outage_id"),
}
# tables that are asked for by place: longitude, latitude, and the key that spreads a very common place. They are laid
# along a space-filling curve, so that the ranges of both coordinates in a row group are narrow
PLACED: dict[str, tuple[str, str, str]] = {
    "gold.poles": ("lon", "lat", "pole_id"),
    "gold.spans": ("lon1", "lat1", "span_id"),
    "gold.customers_pii": ("lon", "lat", "customer_id"),
    "gold.transformers": ("lon", "lat", "transformer_id"),
}
# and by line: a Bloom filter of each row group tells whether it can hold the line
LINE_COLUMN = "line_id"


class TableStore:
    def __init__(self, spark: SparkSession, root: str, options: Mapping[str, str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.options = dict(options or {})  # of the Parquet writer

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def _hadoop(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, folder = self._hadoop(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            label = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if label.startswith("v") and fs.exists(marker):
                found.append(int(label[1:]))
        return sorted(found)

    def version(self, name: str) -> int:
        return max(self.versions(name), default=0)

    def exists(self, name: str) -> bool:
        return self.version(name) > 0

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._path(name, version or self.version(name)))

    def replace(self, name: str, df: DataFrame, cluster_by: Sequence[str] | None = None,
                version: int | None = None) -> int:
        """Write the next version, ordered by `cluster_by` or as the table's name asks; earlier ones stay readable until pruned."""
        version = version or self.version(name) + 1
        keys = cluster_by if cluster_by is not None else CLUSTERING.get(name, ())
        options = {}
        plain = f"{self.root}/{name}/unordered-{uuid.uuid4().hex}"
        if cluster_by is None and name in PLACED and set(PLACED[name]) <= set(df.columns):
            lon, lat, key = PLACED[name]
            place = ["_place", key]
            # by the key first: the curve is costly, and a join may leave all rows in one task
            df = self._written(df.repartition(key).withColumn("_place", F.expr(place_number(lon, lat))), plain)
            df = df.repartitionByRange(*place).sortWithinPartitions(*place).drop("_place")
            if LINE_COLUMN in df.columns:
                options[f"parquet.bloom.filter.enabled#{LINE_COLUMN}"] = "true"
        elif keys:
            df = self._written(df, plain).repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.mode("overwrite").options(**options, **self.options).parquet(self._path(name, version))
        fs, path = self._hadoop(plain)
        fs.delete(path, True)
        return version

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        """The table as it comes. Ranges are cut by a sample, and without this it would be computed for both."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def prune(self, name: str, keep: int = 2) -> None:
        for old in self.versions(name)[:-keep]:
            fs, path = self._hadoop(self._path(name, old))
            fs.delete(path, True)

    def append_missing(self, name: str, rows: DataFrame, key: Sequence[str]) -> int:
        """Insert only rows whose key is not there yet."""
        rows = rows.dropDuplicates(list(key))
        if not self.exists(name):
            return self.replace(name, rows)
        current = self.read(name)
        return self.replace(name, current.unionByName(rows.join(current, list(key), "left_anti")))

    def create_view(self, name: str, view: str) -> None:
        self.read(name).createOrReplaceTempView(view)


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A few rows written in the program."""
    return spark.createDataFrame([], schema) if not rows else spark.createDataFrame(list(rows), schema)


def bind(spark: SparkSession, query: str, **parameters) -> DataFrame:
    """A SQL text with named parameters."""
    return spark.sql(query, args=parameters)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
