"""Many-to-one joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BINS = 65536
SALTS = 64  # of a hot key whose rows were not counted, and of null
HOT_SHARE = 0.00001  # keeps the list of hot keys below 100,000
HOT_ROWS = 1_000_000  # rows of a key that one task may get


class HotKeys(list):
    """Hot keys with their numbers of rows, and the rows that one salt should get."""

    def __init__(self, counts: dict, per_salt: int):
        super().__init__(counts)
        self.salts = [max(2, -(-n // max(1, per_salt))) for n in counts.values()]


def hot_keys(
    df: DataFrame, key: str, share: float = HOT_SHARE, min_rows: int = HOT_ROWS
) -> list:
    """Keys with more than ``share`` of the rows and more than ``min_rows``.

    Up to 10^11 rows that is any key with more than ``min_rows``, whatever its share; there are fewer
    than ``1 / share`` of them.  Keys are first counted in a fixed number of hash
    bins; only where a bin is that full are its keys counted one by one.  Both jobs read the key
    column alone.
    """
    binned = (
        df.select(key)
        .filter(F.col(key).isNotNull())
        .withColumn("bin", F.pmod(F.xxhash64(key), F.lit(BINS)))
    )
    bins = binned.groupBy("bin").count()
    seen = bins.agg(F.sum("count").alias("rows"), F.max("count").alias("fullest")).first()
    enough = max(share * (seen["rows"] or 0), min_rows)
    if (seen["fullest"] or 0) <= enough:
        return []
    full = [r["bin"] for r in bins.filter(F.col("count") > enough).collect()]  # at most BINS
    counts = binned.filter(F.col("bin").isin(full)).groupBy(key).count()
    found = {r[key]: r["count"] for r in counts.filter(F.col("count") > enough).collect()}
    return HotKeys(found, min_rows)


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: list | None = None
) -> DataFrame:
    """Join ``facts`` to ``lookup`` (unique by ``key``).

    Rows of the ``hot`` keys (from ``hot_keys``) are spread over salts, as many as their number needs,
    and only their lookup rows are repeated.  Rows without a key match nothing; where they stay (an
    outer join) they are spread as well.  The rest is left to Spark, which splits partitions that come
    out skewed.
    """
    if not hot and how == "inner":
        return facts.join(lookup, key, how)
    salts = F.lit(1)
    if hot:
        kind = dict(lookup.dtypes)[key]
        rows = [(str(k), n) for k, n in zip(hot, getattr(hot, "salts", [SALTS] * len(hot)))]
        known = facts.sparkSession.createDataFrame(rows, "hot string, salts int")
        known = F.broadcast(known.select(F.col("hot").cast(kind).alias(key), "salts"))  # see HOT_SHARE
        facts, lookup = facts.join(known, key, "left"), lookup.join(known, key, "left")
        salts = F.coalesce("salts", F.lit(1))
    salts = F.when(F.col(key).isNull(), F.lit(SALTS)).otherwise(salts)
    # The salt hangs on the row's content, so a recomputed task gives the same salts.
    salted = facts.withColumn("salt", F.pmod(F.xxhash64(*facts.columns), salts).cast("int"))
    repeated = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    if hot:
        salted, repeated = salted.drop("salts"), repeated.drop("salts")
    return salted.join(repeated, [key, "salt"], how).drop("salt")
