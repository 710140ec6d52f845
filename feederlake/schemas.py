"""The landed extracts: one record type per entity, with format and key."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Extract:
    """How an entity lands: file format, declared columns (DDL), business key."""

    name: str
    format: str
    columns: str
    key: tuple[str, ...]


EXTRACTS: dict[str, Extract] = {
    e.name: e
    for e in (
        Extract("ced", "json",
                "ced_code STRING, ced_name STRING, region_name STRING, is_urban BOOLEAN, boundary_wkt STRING",
                ("ced_code",)),
        Extract("substations", "json",
                "substation_code STRING, substation_name STRING, ced_code STRING, lon DOUBLE, lat DOUBLE, "
                "capacity_mva DOUBLE",
                ("substation_code",)),
        Extract("lines", "json",
                "line_id STRING, substation_code STRING, ced_code STRING, voltage_kv INT, commissioning_year INT, "
                "conductor STRING",
                ("line_id",)),
        Extract("poles", "csv",
                "pole_id STRING, line_id STRING, branch_id STRING, branch_seq INT, parent_pole_id STRING, lon DOUBLE, "
                "lat DOUBLE, install_year INT, material STRING, height_m DOUBLE",
                ("pole_id",)),
        Extract("transformers", "csv",
                "transformer_id STRING, pole_id STRING, kva DOUBLE, install_year INT, phase STRING, "
                "manufacturer STRING",
                ("transformer_id",)),
        Extract("protection_devices", "csv",
                "device_id STRING, device_type STRING, line_id STRING, protected_branch_id STRING, pole_id STRING, "
                "lon DOUBLE, lat DOUBLE, rating_a INT, install_year INT",
                ("device_id",)),
        Extract("customers", "csv",
                "customer_id STRING, transformer_id STRING, customer_name STRING, address STRING, "
                "municipality STRING, lon DOUBLE, lat DOUBLE, customer_type STRING, electric_heating BOOLEAN, "
                "contract_kw DOUBLE",
                ("customer_id",)),
        Extract("outages", "json",
                "outage_id STRING, device_id STRING, start_ts STRING, end_ts STRING, cause STRING, "
                "customers_interrupted INT, fault_lon DOUBLE, fault_lat DOUBLE",
                ("outage_id",)),
        Extract("weather", "csv",
                "date DATE, ced_code STRING, temp_min_c DOUBLE, temp_max_c DOUBLE",
                ("date", "ced_code")),
        # Meter readings have no key: they are never re-landed and never deduplicated.
        Extract("transformer_load", "parquet",
                "transformer_id STRING, reading_date DATE, peak_kva DOUBLE, energy_kwh DOUBLE",
                ()),
    )
}

# Vocabulary of the data.
BREAKER = "DISJONCTEUR"
CUTOUT = "COUPE-CIRCUIT"
TRUNK_SUFFIX = "-T"
TRUNK = "TRONC"
LATERAL = "DÉRIVATION"
TIER_HIGH = "ÉLEVÉ"
TIER_MEDIUM = "MOYEN"
TIER_LOW = "FAIBLE"
ALL_CENTRES = "*"
ADMIN_GROUP = "admins"
TEXT_MASK = "*** masqué / masked ***"
OLD_ASSET_YEAR = 1985
OVERLOAD_PCT = 150
RIGHT_OF_WAY_M = 15.0
ZONE_MARGIN_M = 30.0
