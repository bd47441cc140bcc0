"""Small fixed tables for regions, services and prices, as literal lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values -------------------------------------------------------------------------------
GCC = ["AE", "SA", "KW", "QA", "BH", "OM", "JO"]
EU = [
    "DE", "FR", "IT", "ES", "NL", "SE", "PL", "BE", "AT", "DK", "IE", "PT", "CZ", "FI", "RO", "HU",
    "GR",
]
DEFAULT_SERVICE = "standard"
# Business days at least and at most, per service; and what a zone adds to each.
MIN_DAYS = {"standard": 3, "express": 1, "economy": 5}
MAX_DAYS = {"standard": 7, "express": 3, "economy": 12}
MIN_BUMP = {"INTRA_COUNTRY": -1, "INTRA_REGION": 0, "INTERCONTINENT": 2}
MAX_BUMP = {"INTRA_COUNTRY": 0, "INTRA_REGION": 1, "INTERCONTINENT": 5}
# USD for the first half kilogram and for each further one; factor per service.
FIRST_HALF = {"INTRA_COUNTRY": "3.5", "INTRA_REGION": "6.0", "INTERCONTINENT": "12.0"}
NEXT_HALF = {"INTRA_COUNTRY": "1.0", "INTRA_REGION": "2.0", "INTERCONTINENT": "4.0"}
MULTIPLIER = {"express": "1.6", "standard": "1.0", "economy": "0.8"}
VOLUMETRIC_DIVISOR = 5000.0
# ------------------------------------------------------------------------------------------------


def lookup(table: dict[str, object], key: Column, kind: str, default: object = None) -> Column:
    """Value of ``key`` in a fixed table, as an expression: no join, and no job to ship the table."""
    entries = F.create_map(
        *[part for k, v in table.items() for part in (F.lit(k), F.lit(v).cast(kind))]
    )
    return F.coalesce(F.try_element_at(entries, key), F.lit(default).cast(kind))


def region(cc: Column) -> Column:
    """GCC, EU or null for an upper-case country code."""
    return F.when(cc.isin(GCC), F.lit("GCC")).when(cc.isin(EU), F.lit("EU"))
