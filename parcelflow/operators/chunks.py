"""Overlapping character windows over whole texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import let
from ..functions.text import strip

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Stripped, non-blank windows; the last one is the first that reaches the end of the text.

    The text is cut once into pieces of one step each, and a window is its piece plus what it needs
    of the following ones, so the work grows with the length of the text and not with its square.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below size {size}")
    step = size - overlap
    reach = math.ceil(size / step)
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))

    def windows(parts: Column) -> Column:
        # Start i is needed unless an earlier window reached the end.
        chars = (F.size(parts) - 1) * step + F.char_length(F.element_at(parts, -1))
        count = F.greatest(F.ceil((chars - size) / F.lit(step)).cast("int") + 1, F.lit(1))
        starts = F.sequence(F.lit(1), count)
        cut = F.transform(
            starts, lambda i: F.substring(F.array_join(F.slice(parts, i, reach), ""), 1, size)
        )
        return F.filter(F.transform(cut, strip), lambda w: F.char_length(w) > 0)

    none = F.array().cast("array<string>")
    return let(pieces, lambda p: F.when(F.size(p) > 0, windows(p)).otherwise(none))


def chunk_text(
    docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk, with its 0-based number as the string ``chunk_id``."""
    others = [c for c in docs.columns if c != text]
    return docs.select(
        *others, F.posexplode(chunk_array(F.col(text), size, overlap)).alias("pos", text)
    ).select(*others, F.col("pos").cast("string").alias("chunk_id"), text)
