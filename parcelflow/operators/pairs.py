"""Reply pairs: customer tweets joined to the company reply they point at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import non_empty
from ..functions.text import strip
from .lookup import HOT_ROWS, HOT_SHARE, hot_keys, lookup_join

MISSING_IDS = ["nan", "NaN", "None"]


def to_bool(c: Column) -> Column:
    """true/1 in any case is true; everything else, null included, is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1"), F.lit(False))


def to_id(c: Column) -> Column:
    """Trimmed, without a trailing ``.0``; null where missing."""
    text = F.regexp_replace(strip(c.cast("string")), r"\.0$", "")
    return F.when(~text.isin(MISSING_IDS), non_empty(text))


def check_unique(df: DataFrame, key: str) -> None:
    """Raise if a non-null key occurs twice."""
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"{key} is not unique, e.g. {repeated.first()[key]!r}")


def reply_pairs(
    tweets: DataFrame,
    *,
    validate: bool = True,
    split_ids: bool = False,
    hot_share: float | None = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(src_key, input_raw, assistant_raw) for each inbound tweet whose reply exists.

    ``split_ids`` also follows comma-separated response ids.  Replies that more than
    ``hot_rows`` customer tweets point at are salted (``hot_share`` bounds their list, null turns it off).
    """
    inbound = to_bool(F.col("inbound"))
    response = F.col("response_tweet_id")
    if split_ids:
        response = F.explode(F.split(response, ","))
    customers = (
        tweets.filter(inbound)
        .select(
            to_id(F.col("tweet_id")).alias("src_key"),
            response.alias("response"),
            F.col("text").alias("input_raw"),
        )
        .select("src_key", to_id(F.col("response")).alias("reply_id"), "input_raw")
        .filter(F.col("reply_id").isNotNull() & F.col("input_raw").isNotNull())
    )
    companies = tweets.filter(~inbound).select(
        to_id(F.col("tweet_id")).alias("reply_id"), F.col("text").alias("assistant_raw")
    )
    if validate:
        check_unique(companies, "reply_id")
    answered = companies.filter("reply_id IS NOT NULL AND assistant_raw IS NOT NULL")
    hot = hot_keys(customers, "reply_id", hot_share, hot_rows) if hot_share else []
    return lookup_join(customers, answered, "reply_id", hot=hot).select(
        "src_key", "input_raw", "assistant_raw"
    )
