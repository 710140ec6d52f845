"""Winter seasons and trailing periods, always relative to a given instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

WINTER_PREFIX = "Hiver "


def winter_name(year: int) -> str:
    return f"{WINTER_PREFIX}{year}"


def winter_label(day: Column) -> Column:
    """December counts for the following year; April to November have no label."""
    year = F.when(F.month(day) == 12, F.year(day) + 1).when(F.month(day) <= 3, F.year(day))
    return F.concat(F.lit(WINTER_PREFIX), year.cast("string"))


def instant(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def months_before(as_of: datetime, months: int) -> Column:
    """Midnight of the day that lies so many months before the instant."""
    return F.add_months(F.lit(as_of.strftime("%Y-%m-%d")).cast("date"), -months).cast("timestamp")


def since_months(moment: Column, as_of: datetime, months: int) -> Column:
    return moment >= months_before(as_of, months)
