"""Exact deduplication on a normalised key, keeping the first row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import dedup_key


def pair_digest(*texts: Column) -> Column:
    """Fixed-width stand-in for the normalised texts."""
    return F.unhex(F.sha2(F.to_json(F.array(*[dedup_key(t) for t in texts])), 256))


def keep_first(df: DataFrame, key: Column, order: str, columns: list[str] | None = None) -> DataFrame:
    """One row for each key: the smallest by ``order``, equal ones by the other columns.

    ``order`` may repeat or be null.  Rows are combined before the shuffle, so a key that holds a third
    of all rows sends one row per task.  ``columns`` (default: all) are what is kept and moved.
    """
    columns = columns or df.columns
    first = F.min(F.struct(order, *[c for c in columns if c != order]))
    return df.groupBy(key.alias("digest")).agg(first.alias("row")).select("row.*").select(*columns)


def dedup_pairs(df: DataFrame, order: str = "ord") -> DataFrame:
    """Distinct pairs by normalised texts; ``input`` and ``assistant_response`` should be stored
    columns, as the key looks at each text several times."""
    return keep_first(df, pair_digest(F.col("input"), F.col("assistant_response")), order)
