"""Latest record per business key (re-landed extracts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINEAGE = ("_ingested_at", "_source_file")


def latest_record(df: DataFrame, key: Sequence[str], order: Sequence[str] = LINEAGE) -> DataFrame:
    """Keep one row per key: the one ingested last, the file name breaking ties.

    The filter on the row number becomes a group limit that Spark applies before
    the shuffle too, so a key with many copies sends one row per input task.
    """
    window = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
