"""The mapped extracts as if landed twice: later copies with changes and defects.

Rows whose id ends in 0 come again with a changed value; rows ending in 7 come
again broken in a way a quality rule has to notice. The same rules are written as
SQL in oracle.py.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feederlake.functions.calendar import instant
from feederlake.sources.mapped import AS_OF, MappedTables

# entity -> (id column, {column: value when the id ends in 0}, {column: value when it ends in 7}); SQL text
CHANGES: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    "ced": ("ced_code", {"ced_name": "concat(ced_name, ' (2)')"}, {}),
    "substations": ("substation_code", {"capacity_mva": "capacity_mva + 5"}, {"lat": "CAST(0 AS DOUBLE)"}),
    "lines": ("line_id", {"conductor": "'NEW'"}, {}),
    "poles": ("pole_id", {"install_year": "install_year + 1"}, {"lon": "CAST(0 AS DOUBLE)"}),
    "transformers": ("transformer_id", {"manufacturer": "'NEW'"}, {"kva": "CAST(0 AS DOUBLE)"}),
    "protection_devices": ("line_id", {"rating_a": "rating_a + 1"}, {"lat": "CAST(0 AS DOUBLE)"}),
    "customers": ("customer_id", {"contract_kw": "contract_kw + 1"}, {"transformer_id": "CAST(NULL AS STRING)"}),
    "outages": ("outage_id", {"cause": "'REVISED'"}, {"customers_interrupted": "0"}),
    "weather": ("date", {"temp_min_c": "temp_min_c + 1"}, {}),
    "transformer_load": ("transformer_id", {}, {"peak_kva": "-peak_kva"}),
}


def landed_twice(tables: MappedTables) -> Callable[[str], DataFrame]:
    """An extract function with lineage columns and a second, later file."""
    def extract(name: str) -> DataFrame:
        df = tables.entity(name)
        key, changed, broken = CHANGES[name]
        last = F.right(F.col(key).cast("string"), F.lit(1))
        if name == "transformer_load":  # readings have no key: some are simply wrong
            return df.withColumn("peak_kva", F.when(last == "7", -F.col("peak_kva")).otherwise(F.col("peak_kva")))
        again = df.filter(last.isin("0", "7")).withColumns({
            c: F.when(last == "0", F.expr(changed.get(c, c)) if c in changed else F.col(c))
            .otherwise(F.expr(broken[c]) if c in broken else F.col(c))
            for c in {**changed, **broken}})

        def lineage(part: DataFrame, days: int, file: str) -> DataFrame:
            return part.withColumns({"_ingested_at": instant(AS_OF + timedelta(days=days)),
                                     "_source_file": F.lit(file)})

        return lineage(df, 0, "a").unionByName(lineage(again, 1, "b"))

    return extract
