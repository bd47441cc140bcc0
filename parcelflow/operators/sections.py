"""Chunks of markdown by heading: sections packed to a size, questions kept with their answers.

The headings above a line are a stack that windows carry over the lines of a file.  A paragraph is a unit; a question
(a heading that begins with ``Q:``) is one unit with all lines up to the next heading.  Units of the same topic, the
nearest heading of the first two levels, are packed into chunks in their order.  The bodies of a file's chunks, put
together, are its text again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# --- fixed values -------------------------------------------------------------------------------
HEADING = r"(?s)^(#{1,6})[ \t]+(\S.*)\z"
QUESTION = r"^Q\d*[:.)]"
# ------------------------------------------------------------------------------------------------
LEVELS = range(1, 7)
TOPIC_LEVELS = 2
SECTION_SIZE = 1000


def marked_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines (keys, pos, line) with ``heading`` level (0: none), the ``headings`` above, ``topic`` and ``unit`` numbers."""
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumns(
        {
            "heading": F.char_length(F.regexp_extract("line", HEADING, 1)),
            "title": F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"\s+\z", ""),
            "blank": F.trim(F.regexp_replace("line", r"[\t\r]", " ")) == "",
        }
    )
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(*keys).orderBy("pos")
    last = {
        level: F.last(F.when(F.col("heading") == level, F.struct("pos", "title")), ignorenulls=True).over(upto)
        for level in LEVELS
    }
    lines = lines.withColumns({f"h{level}": c for level, c in last.items()})
    above, open_titles = F.lit(-1), []
    for level in LEVELS:
        at = F.coalesce(F.col(f"h{level}.pos"), F.lit(-1))
        # A heading holds until one of a higher level comes.
        open_titles.append(F.when(at > above, F.col(f"h{level}.title")))
        above = F.greatest(above, at)
    newest = above
    lines = lines.withColumns(
        {
            "headings": F.array_compact(F.array(*open_titles)),
            "in_question": F.coalesce(
                *[F.when(F.col(f"h{level}.pos") == newest, F.col(f"h{level}.title").rlike(QUESTION)) for level in LEVELS],
                F.lit(False),
            ),
            "after_blank": F.coalesce(F.lag("blank").over(here), F.lit(False)),
        }
    )
    begins = (F.col("heading") > 0) | (F.col("after_blank") & ~F.col("blank") & ~F.col("in_question"))
    topic = F.col("heading").between(1, TOPIC_LEVELS)
    return lines.withColumns(
        {
            "unit": F.sum(begins.cast("int")).over(upto), "topic": F.sum(topic.cast("int")).over(upto),
            "last": F.lead("pos").over(here).isNull(),
        }
    )


def packed_numbers(sizes: Column, size: int) -> Column:
    """For each unit the number of its chunk: a unit goes into the open one while that stays within ``size``."""

    def packed(batch: pa.Array) -> pa.Array:
        out = []
        for lengths in batch.to_pylist():
            number, held, numbers = 0, 0, []
            for n in lengths:
                if held and held + n > size:
                    number, held = number + 1, 0
                held += n
                numbers.append(number)
            out.append(numbers)
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(packed, "array<int>")(sizes)


def chunk_sections(docs: DataFrame, keys: list[str], text: str = "text", size: int = SECTION_SIZE) -> DataFrame:
    """(keys, chunk_id, headings, text, body) of markdown files; ``keys`` tell files apart.

    ``body`` is what the file holds, character by character; ``text`` is the body under the headings above its first
    line, for search.  A paragraph longer than ``size`` is cut, a question with its answer never is.  Null
    texts give no chunk, empty ones none either; blank bodies are kept, with an empty ``text``.
    """
    lines = marked_lines(docs.filter(F.char_length(text) > 0), keys, text)
    line = F.concat("line", F.when(F.col("last"), "").otherwise("\n"))
    units = lines.groupBy(*keys, "topic", "unit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "").alias("body"),
        F.min_by("headings", "pos").alias("headings"), F.max("in_question").alias("whole"),
    )
    pieces = F.when(F.col("whole"), F.array("body")).otherwise(F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)))
    units = units.select(*keys, "topic", "unit", "headings", F.posexplode(pieces).alias("piece", "body"))
    parts = units.groupBy(*keys, "topic").agg(
        F.array_sort(F.collect_list(F.struct("unit", "piece", "headings", "body"))).alias("parts")
    )
    numbers = packed_numbers(F.transform("parts", lambda p: F.char_length(p["body"])), size)
    parts = parts.select(*keys, "topic", F.explode(F.arrays_zip("parts", numbers.alias("chunk"))).alias("p"))
    parts = parts.select(*keys, "topic", "p.chunk", "p.parts.*")
    chunks = parts.groupBy(*keys, "topic", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "piece", "body"))), lambda x: x["body"]), "").alias("body"),
        F.min_by("headings", F.struct("unit", "piece")).alias("headings"),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("topic", "chunk")) - 1
    bare = F.trim(F.regexp_replace("body", r"\A\s+|\s+\z", ""))
    under = F.concat_ws("\n", F.nullif(F.array_join("headings", " > "), F.lit("")), bare)
    return chunks.select(
        *keys, number.cast("string").alias("chunk_id"), "headings",
        F.when(F.char_length(bare) > 0, under).otherwise("").alias("text"), "body",
    )
