"""Exact seeded selection of the n smallest rows per group, without ranking whole groups.

A seeded hash of the row key stands for the random order.  To take the n first rows of a group,
hashes are counted by prefix, the prefix bin that holds the n-th row is found on that small table,
and only the rows of that bin are ranked.  That gives one cut per group; being chosen is then a
plain comparison per row, so the payload is neither shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

PREFIX_HEX = 4  # 65,536 bins per group and step
LONGEST_PREFIX = 32  # of the hexadecimal hash
MAX_RANKED = 1_000_000
MAX_LITERALS = 1_000  # groups whose cuts are written into the plan; more are joined
ABOVE_ALL = "~"  # sorts after every hash


def hash_order(seed: str, *key: Column) -> Column:
    """Seeded order: md5 hex of the seed and the key, followed by the key itself to be total."""
    text = F.concat_ws(":", *[k.cast("string") for k in key])
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")), F.lit(":"), text)


def _cut_bins(rows: DataFrame, wanted: list[tuple[str, int]], length: int) -> list[Row]:
    """(grp, bin, nth, in_bin): the prefix of ``length`` that holds the n-th row of each group.

    ``bin`` is null for groups with fewer rows than that.
    """
    quotas = F.broadcast(rows.sparkSession.createDataFrame(wanted, "grp string, n bigint"))
    upto = Window.partitionBy("grp").orderBy("bin")  # a row for each prefix, not for each row
    bins = (
        rows.groupBy("grp", F.substring("key", 1, length).alias("bin")).agg(F.count("*").alias("in_bin"))
        .join(quotas, "grp")
        .withColumn("through", F.sum("in_bin").over(upto))
    )
    holds_cut = (F.col("through") >= F.col("n")) & (F.col("through") - F.col("in_bin") < F.col("n"))
    return (
        bins.groupBy("grp")
        .agg(
            F.max(F.when(holds_cut, F.col("bin"))).alias("bin"),
            F.max(F.when(holds_cut, F.col("n") - F.col("through") + F.col("in_bin"))).alias("nth"),
            F.max(F.when(holds_cut, F.col("in_bin"))).alias("in_bin"),
        )
        .collect()  # one row for each of the wanted groups
    )


def cut_points(
    df: DataFrame, group: str, order: str, sizes: dict[str, int]
) -> dict[str, str]:
    """The n-th smallest ``order`` of each group in ``sizes`` (group -> n).

    Runs small jobs over the two columns and collects one row per group; a prefix that holds more than
    MAX_RANKED rows is counted again by longer ones, so no task ranks more (but for equal keys).  Groups
    with no more than n rows get ABOVE_ALL; groups without rows or with n < 1 do not appear.
    """
    spark = df.sparkSession
    wanted = [(g, n) for g, n in sizes.items() if n > 0]
    if not wanted:
        return {}
    rows = df.select(F.col(group).alias("grp"), F.col(order).alias("key"))
    found = _cut_bins(rows, wanted, PREFIX_HEX)
    cuts = {r["grp"]: ABOVE_ALL for r in found if r["bin"] is None}
    found = [r for r in found if r["bin"] is not None]
    length = PREFIX_HEX
    while found:
        at = [(r["grp"], r["bin"], r["nth"]) for r in found]
        cut_bins = F.broadcast(spark.createDataFrame(at, "grp string, bin string, nth bigint"))
        inside = rows.withColumn("bin", F.substring("key", 1, length)).join(cut_bins, ["grp", "bin"])
        if length >= LONGEST_PREFIX or max(r["in_bin"] for r in found) <= MAX_RANKED:
            ranked = inside.withColumn(
                "rank", F.row_number().over(Window.partitionBy("grp").orderBy("key"))
            )
            cuts.update((r["grp"], r["key"]) for r in ranked.filter("rank = nth").collect())
            break
        length += PREFIX_HEX
        found = _cut_bins(inside.select("grp", "key"), [(g, n) for g, _, n in at], length)
    return cuts


def is_chosen(group: Column, order: Column, cuts: dict[str, str]) -> Column:
    """Whether a row is among the first of its group, given the cuts."""
    if not cuts:
        return F.lit(False)
    table = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])
    return F.coalesce(order <= F.try_element_at(table, group), F.lit(False))


def flag_smallest(
    df: DataFrame, group: str, order: str, sizes: dict[str, int], flag: str = "picked"
) -> DataFrame:
    """Add a boolean that marks the n smallest rows of each group in ``sizes``.

    ``df`` is read three times, twice for its two columns only; hand in a stored table.
    """
    cuts = cut_points(df, group, order, sizes)
    if len(cuts) <= MAX_LITERALS:
        return df.withColumn(flag, is_chosen(F.col(group), F.col(order), cuts))
    table = df.sparkSession.createDataFrame(list(cuts.items()), "_group string, _cut string")
    found = df.join(F.broadcast(table), F.col(group) == F.col("_group"), "left")  # a row for each size
    return found.withColumn(flag, F.coalesce(F.col(order) <= F.col("_cut"), F.lit(False))).drop("_group", "_cut")
