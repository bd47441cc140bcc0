"""Benchmark decontamination by templates.

Numbers, units after them and names become typed placeholders, so a question asked again with other
values has the same template.  Windows of WINDOW template words of the documents are joined with those
of the benchmark by their hash.  Matches of one document and item are grouped by how far apart they lie;
a group counts from RUN windows (or all windows of a shorter item).  Its slots must be consistent: within
the group a value of the item always stands for the same value of the document.  If all values are equal
the passage is verbatim, else the question was asked with new values.

A name is a capitalised word within a sentence (after a lower-case letter, comma, semicolon or colon, and white
space); a number may hold separators and decimals.  Windows are joined in a second form as well, in which names are
lower-case words, so that a verbatim text is found whatever its case.
Windows with fewer than LITERAL words that are no placeholders say too little and are not used.  Items shorter than
a window are joined by their whole template, with windows of just their length, if SHORT_LITERAL of their words are no
placeholders; other items without a usable window are never found, as their words could stand anywhere.

Texts of any length are taken whole.  Null and empty texts match nothing, an empty benchmark leaves all documents clean.  Rows that repeat an
id are told apart by their text; rows equal in both are found together.  Null ids are reported as null.
Other columns are carried by ``clean`` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import settled, stage

from .common import fresh_name, maybe_broadcast

WINDOW = 8
LITERAL = 4
SHORT_LITERAL = 5  # in items shorter than a window
RUN = 6  # windows, that is 13 words

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inches feet yards miles meters metres kilometers kilometres g kg mg lb lbs oz "
    "grams kilograms pounds ounces tons l ml liters litres gallons s sec ms min h hr hrs seconds minutes "
    "hours days weeks months years percent degrees dollars cents euros usd eur gbp mph kmh kb mb gb tb"
).split()
MARK, VALUE = "\x01", "\x02"
POINT = "\x03"  # within a number
NAME = r"\p{Lu}(?<=[\p{Ll},;:]\s{1,8}\p{Lu})\p{L}*?\p{Ll}\p{L}*"  # looks back only once it is at a capital
SEPARATOR = r"([0-9])[.,'\u2019](?=[0-9])"
NUMBER = rf"([0-9]+(?:{POINT}[0-9]+)*)(?:\s{{0,4}}((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))\b)?"
BETWEEN = rf"[^\p{{L}}\p{{N}}{MARK}{VALUE}{POINT}]+"


def _marked(text: Column, name: str, number: str) -> Column:
    joined = F.regexp_replace(F.replace(text, F.lit(POINT), F.lit(" ")), SEPARATOR, f"$1{POINT}")
    return F.regexp_replace(F.regexp_replace(joined, NAME, name), NUMBER, number)


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(F.lower(marked), BETWEEN), "")


def template(text: Column, values: bool = False) -> Column:
    """Words of a text in lower case with placeholders for slots; with ``values``, what stood there.

    Both forms have the same words at the same places.
    """
    if values:
        return _words(_marked(text, f" {MARK}n{VALUE}$0 ", f" {MARK}d{VALUE}$1 {MARK}u{VALUE}$2 "))
    return _words(_marked(text, f" {MARK}n ", f" {MARK}d {MARK}u "))


def both_forms(text: Column) -> list[Column]:
    """The template as ``words``, and as ``plain`` with names as words at the same places."""
    marked = _marked(text, f" {MARK}n{VALUE}$0 ", f" {MARK}d {MARK}u ")
    slots = F.regexp_replace(marked, rf"{VALUE}\p{{L}}+", "")
    plain = F.replace(marked, F.lit(f"{MARK}n{VALUE}"), F.lit(""))
    return [_words(slots).alias("words"), _words(plain).alias("plain")]


def windows(rows: DataFrame, keys: list[str], size: int = WINDOW, literals: int = LITERAL) -> DataFrame:
    """(keys, at, form, window): the hash of every usable window of ``size`` words and where it begins.

    ``form`` is 0 for windows of ``words``, 1 for those of ``plain`` that differ.
    """
    at = F.col("at")

    def hashed(column: str) -> Column:
        words = [F.get(column, at + i) for i in range(size)]
        literal = sum(((~w.startswith(MARK)).cast("int") for w in words[1:]), (~words[0].startswith(MARK)).cast("int"))
        return F.when(literal >= literals, F.xxhash64(*words))

    placed = rows.select(*keys, "words", "plain", F.posexplode("words").alias("at", "word"))
    whole = placed.filter(at <= F.size("words") - size)
    both = whole.select(*keys, "at", hashed("words").alias("slot"), hashed("plain").alias("bare"))
    usable = both.filter("slot is not null or bare is not null")
    forms = F.when(F.col("slot").eqNullSafe(F.col("bare")), F.array("slot")).otherwise(F.array("slot", "bare"))
    return usable.select(*keys, "at", F.posexplode(forms).alias("form", "window")).filter("window is not null")


def _keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), *columns)


def found_groups(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, shift, places): matched windows of a document and item in line."""
    items = benchmark.select("item_id", *both_forms(F.col("text")))
    asked = stage(
        windows(items, ["item_id"]).groupBy("item_id", F.col("at").alias("item_at"), "window").agg(F.min("form").alias("form")),
        "benchmark-windows",
    )
    told = windows(_keyed(docs, *both_forms(F.col("text"))), ["doc_id", "text_key"]).drop("form")
    met = told.join(maybe_broadcast(asked.drop("form")), "window")
    groups = met.groupBy("doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("at").alias("places")  # no more than the item has windows
    )
    # Windows that say enough only with their names are no more than others need.
    slots = F.count_distinct(F.when(F.col("form") == 0, F.col("item_at")))
    usable = F.when(slots > 0, slots).otherwise(F.count_distinct("item_at"))
    needed = asked.groupBy("item_id").agg(F.least(usable, F.lit(RUN)).alias("needed"))
    out = groups.join(needed, "item_id").filter(F.size("places") >= F.col("needed")).drop("needed")
    lengths = items.select(F.size("words").alias("n")).filter(F.col("n").between(SHORT_LITERAL, WINDOW - 1)).distinct()
    for n in sorted(r["n"] for r in lengths.collect()):  # fewer than WINDOW
        short = windows(items.filter(F.size("words") == n), ["item_id"], n, SHORT_LITERAL)
        short = stage(short.select("item_id", "window").distinct(), "short-items")
        told = windows(_keyed(docs, *both_forms(F.col("text"))), ["doc_id", "text_key"], n, SHORT_LITERAL)
        met = told.join(maybe_broadcast(short), "window")
        # Every place is a passage of its own.
        places = met.select("doc_id", "text_key", "item_id", F.col("at").alias("shift"), F.array("at").alias("places"))
        out = out.unionByName(places.distinct())
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item: doc_id, text_key, item_id, windows, slots, verbatim.

    Of several passages of the same item in a document the longest is shown.
    """
    groups = stage(found_groups(docs, benchmark), "matches")
    keys = stage(groups.select("text_key").distinct(), "matched-texts")
    own = _keyed(docs, F.col("text"))
    own = own.join(maybe_broadcast(keys), "text_key", "left_semi").select("text_key", "text")
    own = own.dropDuplicates(["text_key"]).select("text_key", template(F.col("text"), values=True).alias("own"))
    asked = benchmark.select("item_id", template(F.col("text"), values=True).alias("asked"))
    rows = groups.join(own, "text_key").join(asked, "item_id")
    covered = F.array_distinct(
        F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.least(F.lit(WINDOW), F.size("asked")) - 1)))
    )
    pairs = F.transform(
        covered,
        lambda p: F.struct(
            F.get(F.col("asked"), p - F.col("shift")).alias("asked"), F.get(F.col("own"), p).alias("own")
        ),
    )
    # A name may be a word on one side, as letter case differs.
    bare = lambda w: F.regexp_replace(w, f"^{MARK}n{VALUE}", "")
    held = F.filter(pairs, lambda x: x["own"].startswith(MARK) | x["asked"].startswith(MARK))
    slots = F.array_distinct(
        F.transform(held, lambda x: F.struct(bare(x["asked"]).alias("asked"), bare(x["own"]).alias("own")))
    )
    checked = rows.select("doc_id", "text_key", "item_id", F.size("places").alias("windows"), slots.alias("slots"))
    values = F.array_distinct(F.transform("slots", lambda x: x["asked"]))
    consistent = checked.filter(F.size("slots") == F.size(values))
    verbatim = F.forall("slots", lambda x: x["asked"] == x["own"])
    best = F.max(F.struct("windows", F.size("slots").alias("slots"), verbatim.alias("verbatim")))
    return consistent.groupBy("doc_id", "text_key", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_key", "item_id",
        F.col("best.windows").cast("bigint").alias("windows"),
        F.col("best.slots").cast("bigint").alias("slots"),
        F.col("best.verbatim").alias("verbatim"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose text holds no passage of the benchmark."""
    key, own = fresh_name(docs, "found_text"), fresh_name(docs, "text_key")

    def keys() -> DataFrame:
        return contaminated(docs, benchmark).select(F.col("text_key").alias(key)).distinct()

    found = maybe_broadcast(settled(docs.sparkSession, "contaminated", keys))
    marked = docs.withColumn(own, F.xxhash64(docs["text"]))
    return marked.join(found, F.col(own) == F.col(key), "left_anti").select(docs.columns)
