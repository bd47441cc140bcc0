"""Small Column helpers."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, however often that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))
