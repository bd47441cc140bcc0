"""Delivery-time and price reports over shipment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import lanes as L
from ..operators.lookup import hot_keys, lookup_join


def shipments(
    lines: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    suppliers: DataFrame,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Order lines with s_nationkey, c_nationkey, o_orderpriority and, with ``parts``, p_size.

    Every join looks one row up per line, so hot orders, customers, suppliers and parts are salted
    and nothing is grouped on the way.
    """
    placed = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderpriority"
    )
    homes = customers.select("c_custkey", "c_nationkey")
    placed = lookup_join(placed, homes, "c_custkey", hot=hot_keys(placed, "c_custkey")).drop("c_custkey")
    origins = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    found = lookup_join(lines, origins, "l_suppkey", hot=hot_keys(lines, "l_suppkey"))
    if parts is not None:
        sizes = parts.select(F.col("p_partkey").alias("l_partkey"), "p_size")
        found = lookup_join(found, sizes, "l_partkey", hot=hot_keys(lines, "l_partkey"))
    return lookup_join(found, placed, "l_orderkey", hot=hot_keys(lines, "l_orderkey"))


def eta_by_lane(rows: DataFrame) -> DataFrame:
    """Shipments and days per lane and service; the days are found once per lane."""
    counts = rows.groupBy("origin_cc", "dest_cc", "service").agg(F.count("*").alias("shipments"))
    return L.estimate_eta(counts).select(
        "origin_cc", "dest_cc", "service", "shipments", "min_days", "max_days"
    )


def quote_by_zone(rows: DataFrame) -> DataFrame:
    """Shipments, billed kilograms and price per zone and service."""
    return (
        L.rate_quote(rows)
        .groupBy("zone", "service")
        .agg(
            F.count("*").alias("shipments"),
            F.sum("price_usd").alias("price_usd"),
            F.sum(F.col("billable_kg").cast("decimal(18,2)")).alias("billed_kg"),
        )
    )
