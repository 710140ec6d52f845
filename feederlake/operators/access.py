"""Governance: row filter by operating centre, text mask, coarser locations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feederlake.functions.hexgrid import centre_lat, centre_lon, centre_x, centre_y
from feederlake.schemas import ADMIN_GROUP, ALL_CENTRES, TEXT_MASK

PII_GROUP = "pii_readers"


@dataclass(frozen=True)
class Caller:
    """Who asks, and the groups they belong to."""

    principal: str
    groups: frozenset[str] = field(default_factory=frozenset)

    @property
    def is_admin(self) -> bool:
        return ADMIN_GROUP in self.groups

    @property
    def reads_pii(self) -> bool:
        return PII_GROUP in self.groups


def access_table(spark: SparkSession, grants: Iterable[tuple[str, str]]) -> DataFrame:
    """The mapping (principal, ced_code); the code ``*`` stands for every centre."""
    return spark.createDataFrame(list(grants), "principal string, ced_code string")


def merge_access(current: DataFrame, grants: DataFrame) -> DataFrame:
    """Insert-only merge on both columns."""
    fresh = grants.distinct().join(current, ["principal", "ced_code"], "left_anti")
    return current.unionByName(fresh)


def row_filter(df: DataFrame, caller: Caller, access: DataFrame, column: str = "ced_code") -> DataFrame:
    """Rows of the centres mapped to the caller or to one of their groups.

    A caller's codes, at most as many as there are operating centres, are read first and become a list in the filter,
    which reaches the scan.
    """
    if caller.is_admin:
        return df
    mine = access.filter(F.col("principal").isin(caller.principal, *sorted(caller.groups))).select("ced_code").distinct()
    codes = sorted(row.ced_code for row in mine.collect() if row.ced_code is not None)
    return df if ALL_CENTRES in codes else df.filter(F.col(column).isin(codes))


def masked_text(value: Column, caller: Caller) -> Column:
    """The value for readers of personal data, the mask (also for NULL) otherwise."""
    return value if caller.reads_pii else F.lit(TEXT_MASK)


def masked_place(df: DataFrame, caller: Caller, cell: str = "hex_cell_8") -> DataFrame:
    """Exact lon, lat, x, y for readers of personal data, the cell's centre otherwise."""
    if caller.reads_pii:
        return df
    centre = {"lon": centre_lon(cell), "lat": centre_lat(cell), "x": centre_x(cell), "y": centre_y(cell)}
    return df.withColumns({c: F.expr(e) for c, e in centre.items()})


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach bilingual column descriptions as metadata."""
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df
