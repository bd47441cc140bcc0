"""Zone, delivery time and price for whole shipment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims

HALVER = 134217729.0  # 2**27 + 1: multiplying by it splits a double into two short halves


def with_cents(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``source`` rounded to two decimals by its exact binary value, ties to even.

    That is Python's rule; SQL rounding goes by the printed decimals.  A value is compared with the
    midpoint of its cents, and where both are the same double, the midpoint's own rounding error,
    which is recovered exactly, decides.
    """
    v, floor, mid, high = F.col(source), F.col("_floor"), F.col("_mid"), F.col("_high")
    one = F.lit(1)
    scaled = mid * 200.0
    error = (high * 200.0 - scaled) + (mid - high) * 200.0
    excess = (scaled - (2 * floor + 1)) + error  # above zero if the stored midpoint is too large
    odd = F.pmod(floor, F.lit(2)) == 1
    up = (v > mid) | ((v == mid) & ((excess > 0) | ((excess == 0) & odd)))
    return (
        df.withColumn("_floor", F.floor(v * 100))
        # The product can land one step off the true floor.
        .withColumn("_floor", floor - F.when(floor / F.lit(100.0) > v, one).otherwise(0))
        .withColumn("_floor", floor + F.when((floor + 1) / F.lit(100.0) <= v, one).otherwise(0))
        .withColumn("_mid", (2 * floor + 1) / F.lit(200.0))
        .withColumn("_high", mid * HALVER - (mid * HALVER - mid))
        .withColumn(target, (floor + F.when(up, one).otherwise(0)) / F.lit(100.0))
        .drop("_floor", "_mid", "_high")
    )


def zone(origin: Column, dest: Column) -> Column:
    """Zone of a lane from upper-case country codes.

    Same country, also if both are empty, is INTRA_COUNTRY; the same named region INTRA_REGION;
    everything else INTERCONTINENT, two countries outside all regions included.
    """
    return (
        F.when(origin == dest, F.lit("INTRA_COUNTRY"))
        .when(dims.region(origin) == dims.region(dest), F.lit("INTRA_REGION"))
        .otherwise(F.lit("INTERCONTINENT"))
    )


def country(cc: Column) -> Column:
    return F.upper(F.coalesce(cc, F.lit("")))


def service_name(service: Column) -> Column:
    """Lower case; null and empty mean standard."""
    return F.lower(F.coalesce(F.nullif(service, F.lit("")), F.lit(dims.DEFAULT_SERVICE)))


def eta_days(zone_name: Column, service: Column) -> tuple[Column, Column]:
    """At least one business day and no fewer at most; unknown services get standard days."""
    standard = dims.DEFAULT_SERVICE
    low = dims.lookup(dims.MIN_DAYS, service, "int", dims.MIN_DAYS[standard]) + dims.lookup(
        dims.MIN_BUMP, zone_name, "int"
    )
    high = dims.lookup(dims.MAX_DAYS, service, "int", dims.MAX_DAYS[standard]) + dims.lookup(
        dims.MAX_BUMP, zone_name, "int"
    )
    least = F.greatest(F.lit(1), low)
    return least, F.greatest(least, high)


def billable_kg(kg: Column, length: Column, width: Column, height: Column) -> Column:
    """At least 0.01 kg; the volumetric weight if all three sides are given and it is larger."""
    actual = F.greatest(F.lit(0.01), F.coalesce(kg.cast("double"), F.lit(0.0)))
    sides = (length > 0) & (width > 0) & (height > 0)
    volume = length * width * height / F.lit(dims.VOLUMETRIC_DIVISOR)
    return F.greatest(actual, F.when(sides, volume.cast("double")))


def price_usd(zone_name: Column, service: Column, billable: Column) -> Column:
    """First half kilogram at the base price, each further one a step, times the service factor."""
    halves = F.greatest(F.lit(1), F.ceil(billable / F.lit(0.5)))
    first = dims.lookup(dims.FIRST_HALF, zone_name, "decimal(6,2)")
    step = dims.lookup(dims.NEXT_HALF, zone_name, "decimal(6,2)")
    factor = dims.lookup(dims.MULTIPLIER, service, "decimal(4,2)", "1.0")
    return F.round((first + step * (halves - 1).cast("decimal(16,0)")) * factor, 2).cast("decimal(20,2)")


def _with_lane(shipments: DataFrame) -> DataFrame:
    return (
        shipments.withColumn("origin_cc", country(F.col("origin_cc")))
        .withColumn("dest_cc", country(F.col("dest_cc")))
        .withColumn("service", service_name(F.col("service")))
        .withColumn("zone", zone(F.col("origin_cc"), F.col("dest_cc")))
    )


def estimate_eta(shipments: DataFrame) -> DataFrame:
    """Add zone, min_days and max_days to rows with origin_cc, dest_cc, service."""
    low, high = eta_days(F.col("zone"), F.col("service"))
    return _with_lane(shipments).withColumn("min_days", low).withColumn("max_days", high)


def rate_quote(shipments: DataFrame) -> DataFrame:
    """Add zone, price_usd and billable_kg to rows with origin_cc, dest_cc, service, weight_kg and
    l_cm, w_cm, h_cm."""
    weight = billable_kg(F.col("weight_kg"), F.col("l_cm"), F.col("w_cm"), F.col("h_cm"))
    priced = (
        _with_lane(shipments)
        .withColumn("_billable", weight)
        .withColumn("price_usd", price_usd(F.col("zone"), F.col("service"), F.col("_billable")))
    )
    return with_cents(priced, "_billable", "billable_kg").drop("_billable")
