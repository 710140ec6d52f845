"""A keyed copy of an operational table that follows its change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feederlake.operators.latest import latest_record
from feederlake.operators.snapshot import DELETE, KeyedTable
from feederlake.sources.tables import TableStore


class Mirror:
    """The copy. Each row knows the feed version it comes from, deleted keys included,
    so repeated or late changes have no effect."""

    def __init__(self, source: KeyedTable, store: TableStore):
        self.source, self.store = source, store
        self.name, self.key = source.name, source.key
        self._checkpoint = f"{store.root}/_checkpoints/{self.name}"

    def rows(self) -> DataFrame:
        """What is served."""
        return self.store.read(self.name).filter("not _deleted").drop("_deleted", "_version")

    def _apply(self, batch: DataFrame, epoch: int) -> None:
        arrived = batch.select(
            *[c for c in batch.columns if c not in ("_op", "change_version")],
            F.col("change_version").cast("int").alias("_version"), (F.col("_op") == DELETE).alias("_deleted"))
        if self.store.exists(self.name):
            arrived = self.store.read(self.name).unionByName(arrived, allowMissingColumns=True)
        self.store.replace(self.name, latest_record(arrived, [self.key], ["_version"]))

    def follow(self) -> None:
        """Apply every change that has not been applied yet, then stop."""
        spark = self.store.spark
        schema = spark.read.option("mergeSchema", "true").parquet(self.source.feed_path).schema
        fields = [f for f in schema.fields if f.name != "change_version"]
        feed = spark.readStream.schema(T.StructType([*fields, T.StructField("change_version", T.IntegerType())]))
        query = (feed.parquet(self.source.feed_path).writeStream.foreachBatch(self._apply)
                 .option("checkpointLocation", self._checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def rebuild(self) -> None:
        """Start again from the source's snapshot, with a new checkpoint."""
        version = self.source.store.version(self.name)
        fresh = self.source.snapshot().withColumns({"_version": F.lit(version), "_deleted": F.lit(False)})
        self.store.replace(self.name, fresh)
        self._checkpoint = f"{self.store.root}/_checkpoints/{self.name}-{uuid.uuid4().hex}"

    def agrees(self) -> bool:
        """Same number of rows and same content as the source's snapshot."""
        if not self.store.exists(self.name):
            return False
        columns = sorted(self.source.snapshot().columns)

        def digest(df: DataFrame) -> tuple:
            row: Column = F.xxhash64(*columns).cast("decimal(38,0)")
            return tuple(df.agg(F.count(F.lit(1)), F.sum(row)).first())

        mine = self.rows()
        return sorted(mine.columns) == columns and digest(mine) == digest(self.source.snapshot())

    def sync(self) -> str:
        """Follow the feed; on failure or a mismatch rebuild once."""
        try:
            self.follow()
            if self.agrees():
                return "incremental"
        except Exception as error:  # a broken checkpoint or feed: the snapshot is the truth
            print(f"{self.name}: following the feed failed, rebuilding: {str(error).splitlines()[0]}")
        self.rebuild()
        if not self.agrees():
            raise RuntimeError(f"{self.name}: the copy differs from its source after a rebuild")
        return "rebuilt"
