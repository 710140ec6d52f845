"""Registered queries against their DuckDB SQL. All of them with FULL_ORACLE=1."""

import os

import pytest
from compare import difference, duck

from feederlake.checks.catalog import CHECKS

QUICK = ("latest_event_per_user", "silver_spans", "silver_customers", "gold_poles", "right_of_way_area",
         "gold_outages", "gold_zone_shapes", "outages_of_centre", "question_device_impact", "snapshot_changes",
         "stream_ingest")
NAMES = list(CHECKS) if os.environ.get("FULL_ORACLE") else QUICK


@pytest.mark.parametrize("name", [n for n in NAMES if CHECKS[n].sql])
def test_equal(spark, folder, name):
    assert difference(CHECKS[name].run(spark, folder), duck(folder), CHECKS[name].sql) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns
