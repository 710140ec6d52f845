"""Column descriptions in French and English, kept as column metadata."""

from __future__ import annotations

COMMENTS: dict[str, dict[str, str]] = {
    "gold.poles": {
        "distance_to_substation_m": "Distance au poste en ligne droite (m) / straight distance to the substation (m)",
        "network_distance_m": "Distance au poste en suivant la ligne (m) / distance to the substation along the line (m)",
        "install_year": "Année de pose du poteau / year the pole was set",
        "age_years": "Âge du poteau (ans) / age of the pole (years)",
        "lon": "Longitude du poteau / longitude of the pole",
    },
    "gold.spans": {"length_m": "Longueur du conducteur entre deux poteaux (m) / conductor length between two poles (m)"},
    "gold.lines": {
        "right_of_way_area_m2": "Superficie de l'emprise (m²) / area of the right of way (m²)",
        "max_distance_to_substation_m": "Plus grande distance en ligne droite (m) / largest straight distance (m)",
        "max_network_distance_m": "Plus grande distance le long de la ligne (m) / largest distance along the line (m)",
    },
    "gold.transformers": {
        "install_year": "Année de pose du transformateur / year the transformer was set",
        "kva": "Puissance nominale (kVA) / rated power (kVA)",
        "zone_id": "Appareil de protection en amont / protecting device upstream",
    },
    "gold.transformer_load_daily": {
        "overload_pct": "Pointe en % de la puissance nominale / peak as % of rated power",
        "winter_label": "Hiver: décembre à mars / winter: December to March",
    },
    "gold.protection_devices": {
        "customers_downstream": "Clients perdus si l'appareil ouvre / customers lost when the device opens",
        "device_type": "DISJONCTEUR (toute la ligne) ou COUPE-CIRCUIT / breaker (whole line) or fuse cutout",
    },
    "gold.customers_pii": {
        "distance_to_substation_m": "Distance au poste en ligne droite (m) / straight distance to the substation (m)",
        "network_distance_m": "Distance au poste par le réseau (m) / distance to the substation along the network (m)",
        "lon": "Longitude exacte, donnée personnelle / exact longitude, personal data",
        "lat": "Latitude exacte, donnée personnelle / exact latitude, personal data",
    },
    "gold.outages": {
        "chi": "Clients-heures interrompus / customer hours interrupted",
        "zone_id": "Appareil qui a ouvert / device that opened",
    },
    "gold.protection_zones": {
        "zone_ring": "Contour de la zone / outline of the zone",
        "chi_6m": "Clients-heures interrompus en six mois / customer hours interrupted in six months",
        "interruptions_3m": "Interruptions en trois mois / interruptions in three months",
    },
}
