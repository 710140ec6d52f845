"""Incremental ingestion of landed files into bronze tables.

A stream over the names of the landed files remembers in its checkpoint which ones
were read. Each of its batches is read by column name and written to a folder of its
own, so a batch that is repeated after a failure replaces itself. A run handles what
is there and stops; old files are not opened again.

A row of CSV or JSON with a value that does not fit the type of its column keeps all
other values; the row as it stood in the file is kept beside it, see ``Landing.rescued``.
"""

from __future__ import annotations

import csv
import json
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feederlake.operators.latest import LINEAGE
from feederlake.schemas import EXTRACTS, Extract

FILES_PER_BATCH = 10_000
STREAMS = 5
_FILE = "path string, modificationTime timestamp, length long, content binary"
RESCUED = "_rescued"
#: Wider types that Parquet files of the narrower one can be read under.
WIDER = {("int", "bigint"), ("int", "double"), ("float", "double")}
_RESCUED = T.StructField(RESCUED, T.StringType())
_LINEAGE = T.StructType([T.StructField("_source_file", T.StringType()), T.StructField("_ingested_at", T.TimestampType())])


class Landing:
    """Landed folders on one side, bronze tables on the other.

    A generation is one set of bronze folders and checkpoints; a full refresh starts
    the next one.
    """

    def __init__(self, spark: SparkSession, landing: str, bronze: str, generation: int = 1):
        self.spark = spark
        self.landing = landing.rstrip("/")
        self.bronze_root = f"{bronze.rstrip('/')}/g{generation}"

    def folder(self, name: str) -> str:
        return f"{self.landing}/{name}"

    def table_path(self, name: str) -> str:
        return f"{self.bronze_root}/{name}"

    # ------------------------------------------------------------ schema

    def schema(self, name: str) -> T.StructType:
        """Declared columns, then those that landed files have added, in the order of their arrival."""
        declared = T.StructType.fromDDL(EXTRACTS[name].columns)
        try:
            stored = self.spark.read.schema("value string").text(f"{self.bronze_root}/_schemas/{name}").withColumn(
                "batch", F.col("batch").cast("long")).orderBy(F.desc("batch")).first()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
                raise
            return declared
        return T.StructType.fromJson(json.loads(stored.value)) if stored else declared

    def _store_schema(self, name: str, batch: int, schema: T.StructType) -> None:
        row = self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.bronze_root}/_schemas/{name}/batch={batch}")

    # ------------------------------------------------------------ files by column name

    def _read(self, extract: Extract, files: list[str], known: T.StructType) -> tuple[DataFrame, T.StructType]:
        """Rows of some files, and the schema grown by what is new in them."""
        if extract.format == "csv":
            return self._read_csv(extract, files, known)
        reader = self.spark.read
        if extract.format == "json":
            grown = self._grown(extract, known, reader.json(files).schema)
            full = T.StructType([*grown.fields, _RESCUED])
            return reader.schema(full).option("columnNameOfCorruptRecord", RESCUED).json(files), grown
        grown = self._grown(extract, known, reader.option("mergeSchema", "true").parquet(*files).schema)
        return reader.schema(grown).parquet(*files).withColumn(RESCUED, F.lit(None).cast("string")), grown

    @staticmethod
    def _grown(extract: Extract, known: T.StructType, found: T.StructType) -> T.StructType:
        """The known columns, those that nobody declared as wide as the new files need, and new ones after them."""
        declared = T.StructType.fromDDL(extract.columns).names
        types = {f.name: f.dataType for f in found.fields}

        def widened(field: T.StructField) -> T.StructField:
            new = types.get(field.name, field.dataType)
            wider = field.name not in declared and (field.dataType.simpleString(), new.simpleString()) in WIDER
            return T.StructField(field.name, new, True) if wider else field

        return _extend(T.StructType([widened(f) for f in known.fields]), found.fields)

    def _read_csv(self, extract: Extract, files: list[str], known: T.StructType) -> tuple[DataFrame, T.StructType]:
        """Files with the same header are read together, each value under the name above it.

        Only files with columns that nobody declared are read once more, for the types of these.
        """
        declared = T.StructType.fromDDL(extract.columns).names
        lines = self.spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start")
        # the first line of the first block of each file
        heads = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header")).collect()
        groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for head in heads:
            names = tuple(n.strip() for n in next(csv.reader([head.header.removeprefix("﻿")]), []))
            if len(set(names)) < len(names) or "" in names:
                raise ValueError(f"{head.file_path}: column names must be there and differ: {names}")
            groups[names].append(unquote(head.file_path))
        for names, members in sorted(groups.items()):
            if any(n not in declared for n in names):
                known = self._grown(extract, known, self.spark.read.csv(members, header=True, inferSchema=True).schema)
        parts = []
        for names, members in sorted(groups.items()):
            own = T.StructType([*(known[n] for n in names), _RESCUED])
            reader = self.spark.read.schema(own).option("header", "true").option("columnNameOfCorruptRecord", RESCUED)
            parts.append(reader.csv(members))
        rows = [p.withColumn("_source_file", F.col("_metadata.file_path")) for p in parts]
        empty = self.spark.createDataFrame([], T.StructType([*known.fields, _RESCUED, _LINEAGE.fields[0]]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows, empty), known

    # ------------------------------------------------------------ runs

    def ingest(self, name: str) -> int:
        """Append what has landed since the last run; returns the rows added."""
        extract = EXTRACTS[name]
        added: dict[int, int] = {}

        def write(batch: DataFrame, number: int) -> None:
            files = [row.path for row in batch.select("path").collect()]  # at most FILES_PER_BATCH names
            if not files:
                return
            known = self.schema(name)
            rows, grown = self._read(extract, files, known)
            if grown != known or number == 0:
                self._store_schema(name, number, grown)
            if "_source_file" not in rows.columns:
                rows = rows.withColumn("_source_file", F.col("_metadata.file_path"))
            target = f"{self.table_path(name)}/batch={number}"
            rows.withColumn("_ingested_at", F.current_timestamp()).select(
                *grown.names, RESCUED, *_LINEAGE.names).write.mode("overwrite").parquet(target)
            added[number] = self.spark.read.parquet(target).count()

        try:
            names = (self.spark.readStream.format("binaryFile").schema(_FILE)
                     .option("maxFilesPerTrigger", FILES_PER_BATCH).load(self.folder(name)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        query = (names.select("path").writeStream.foreachBatch(write)
                 .option("checkpointLocation", f"{self.bronze_root}/_checkpoints/{name}")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return sum(added.values())

    def ingest_all(self) -> dict[str, int]:
        """The same for every registered extract, a few streams side by side: most of a small run is waiting."""
        with ThreadPoolExecutor(STREAMS) as pool:
            return dict(zip(EXTRACTS, pool.map(self.ingest, EXTRACTS), strict=True))

    def _stored(self, name: str, *more: T.StructField) -> DataFrame:
        schema = T.StructType([*self.schema(name).fields, *_LINEAGE.fields, *more])
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.table_path(name))

    def bronze(self, name: str) -> DataFrame:
        """All rows so far, under the stored schema; files from before a column was added have NULL there."""
        return self._stored(name)

    def rescued(self, name: str) -> DataFrame:
        """The rows of which a value did not fit, with the text of the row as it landed in ``_rescued``."""
        return self._stored(name, _RESCUED).filter(F.col(RESCUED).isNotNull())


def _extend(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    known = {f.name for f in schema.fields} | set(LINEAGE) | {RESCUED}
    return T.StructType(schema.fields + [T.StructField(f.name, f.dataType, True) for f in fields
                                         if f.name not in known])
