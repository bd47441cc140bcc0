import random

import pytest

from parcelflow.operators import lanes as L
from parcelflow.plans import lanes as P
from parcelflow.schemas import SHIPMENTS


def shipment(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SHIPMENTS)


@pytest.mark.parametrize(
    "origin, dest, service, days",
    [("JO", "AE", "express", (1, 4)), ("jo", "JO", "Express", (1, 3)), ("JO", "JO", "standard", (2, 7)),
     ("US", "DE", "standard", (5, 12)), ("US", "JO", "economy", (7, 17)), ("US", "CA", None, (5, 12)),
     (None, "", "", (2, 7)), ("JO", "AE", "overnight", (3, 8))],
)
def test_eta(spark, origin, dest, service, days):
    out = L.estimate_eta(shipment(spark, (origin, dest, 1.0, None, None, None, service))).first()
    assert (out["min_days"], out["max_days"]) == days
    assert out["service"] == (service or "standard").lower()


@pytest.mark.parametrize(
    "row, zone, billable, price",
    [(("JO", "AE", 1.0, None, None, None, "standard"), "INTRA_REGION", 1.0, "8.00"),
     (("US", "DE", 2.3, None, None, None, "express"), "INTERCONTINENT", 2.3, "44.80"),
     (("JO", "JO", 0.5, None, None, None, "economy"), "INTRA_COUNTRY", 0.5, "2.80"),
     (("DE", "FR", 1.0, 40.0, 30.0, 20.0, "standard"), "INTRA_REGION", 4.8, "24.00"),
     (("JO", "JO", None, None, None, None, "standard"), "INTRA_COUNTRY", 0.01, "3.50"),
     (("DE", "FR", 1.0, 40.0, 30.0, 0.0, "priority"), "INTRA_REGION", 1.0, "8.00"),
     (("DE", "FR", 2.675, None, None, None, "standard"), "INTRA_REGION", 2.67, "16.00")],
)
def test_quote(spark, row, zone, billable, price):
    out = L.rate_quote(shipment(spark, row)).first()
    assert (out["zone"], out["billable_kg"], str(out["price_usd"])) == (zone, billable, price)


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(8)
    values = [0.01, 2.675, 0.125, 0.375, 1.005, 2.5]
    for _ in range(5000):
        values += [rng.randint(0, 10**6) / 1000, rng.random() * 100, rng.randint(0, 10**5) / 8,
                   (2 * rng.randint(0, 10**6) + 1) / 200]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r["out"] == round(r["v"], 2) for r in L.with_cents(rows, "v", "out").collect())


def test_lane_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(P, "hot_keys", lambda df, key: [0])  # every hot key is 0
    lines = spark.createDataFrame([(i % 3 and i, 0, i % 5) for i in range(300)], "l_orderkey int, l_suppkey int, l_partkey int")
    orders = spark.createDataFrame([(i, i % 2, "5-LOW") for i in range(300)], "o_orderkey int, o_custkey int, o_orderpriority string")
    customers = spark.createDataFrame([(0, 1), (1, 2)], "c_custkey int, c_nationkey int")
    suppliers = spark.createDataFrame([(0, 9)], "s_suppkey int, s_nationkey int")
    parts = spark.createDataFrame([(i, 10 + i) for i in range(5)], "p_partkey int, p_size int")
    rows = P.shipments(lines, orders, customers, suppliers, parts)
    assert rows.count() == 300
    assert {r["p_size"]: r["count"] for r in rows.groupBy("p_size").count().collect()} == {10 + i: 60 for i in range(5)}
    assert {r["c_nationkey"]: r["count"] for r in rows.groupBy("c_nationkey").count().collect()} == {1: 200, 2: 100}
