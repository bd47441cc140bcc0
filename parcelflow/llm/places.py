"""Places of rows in their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from parcelflow.staging import stage

from .common import fresh_name, maybe_broadcast


def places(rows: DataFrame, group: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """``rows`` with their ``place`` in the group, from 0 along ``order`` (nulls first), and the group's ``size``.

    Rows are dealt by ranges of group and order and written in order, so that a group of any size lies in
    several tasks; a group's rows in a task are a run, and only runs are added up.  Equal rows are told apart
    by where they were read, so they too may lie in several tasks; which comes first is any of them.  Values
    of ``group`` must not be null.
    """
    tie, at, part = (fresh_name(rows, name) for name in ("_tie", "_at", "_part"))
    keys = [*group, *order, tie]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks, *keys)
        .sortWithinPartitions(*keys).drop(tie)
    )
    # Written, so that the numbers of tasks and rows hold for all that follows.
    held = stage(ordered.withColumn(at, F.monotonically_increasing_id()), "placed")
    held = held.withColumn(part, F.shiftright(at, 33))
    runs = held.groupBy(part, *group).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(
        runs.select(
            part, *group,
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(whole).alias(size),
        ),
        "runs",
    )
    met = held.join(maybe_broadcast(runs), [part, *group])
    return met.select(*rows.columns, (F.col(at) + F.col("shift")).alias(place), size)
