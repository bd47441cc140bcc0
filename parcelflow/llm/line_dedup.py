"""Removal of repeated lines, exact or within a few edits, by a segment-partition edit join.

Lines of at least MIN_CHARS characters take part; shorter ones stay.  Equal lines are one class whose
place is its first occurrence (by document id, then line).  A line is dropped if it is not the first of
its class, or if a line within ``threshold`` edits has an earlier place.

The edit join: a line is cut into threshold + 1 segments, one of which two such lines must share.  The
segments of each line are indexed with its length; a line probes, for each length up to ``threshold``
below its own, the substrings that can align with a segment.  What meets another line's segment is kept
first, a row for a row; only then are lines paired, if their letter counts allow it, and verified with an
edit distance that keeps a band of 2 * threshold + 1 diagonals in the bits of one number.  Segments that more than HOT lines share do not pair their lines: those lines are joined
again by what is left of them, with that segment as the name of their group, down to short rests, which
are joined by the strings they have in common after threshold deletions.  That is as exact, and no group
meets all pairs.

Null and empty texts have no lines.  A null id counts as below all ids.  Rows with the same id are told
apart by their text; rows that are equal in both are one document and keep or lose the same lines.  Empty
tables give empty results; other columns are carried by ``without_repeats`` and not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import settled, stage

from .common import fresh_name, maybe_broadcast

MIN_CHARS = 24
THRESHOLD = 2
#: A segment shared by more lines than this is refined instead of paired.
HOT = 1_000
#: Rests up to this length are joined by deletions.
SHORT = 24
#: Numbers of dropped lines (four bytes each) that may be sent to every task.
SENT_NUMBERS = 4_000_000
#: Documents that keep less than this share of their characters are dropped.
LEAST_LEFT = 0.1
LOWEST_ID = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    min_chars: int = MIN_CHARS
    threshold: int = THRESHOLD
    hot: int = HOT
    short: int = SHORT
    short_repeats: bool = False  # exact repeats of shorter lines with a word count as well


# --- lines and exact classes -----------------------------------------------------------------------


def document_key(docs: DataFrame) -> Column:
    """A number that orders documents by id, and rows of the same id by their text."""
    number = F.coalesce(docs["doc_id"], F.lit(LOWEST_ID)).cast("decimal(20,0)")
    tie = F.coalesce(F.xxhash64(docs["text"]), F.lit(0)).bitwiseAND(F.lit((1 << 31) - 1))
    return (number * F.lit(1 << 31).cast("decimal(10,0)") + tie.cast("decimal(10,0)")).cast("decimal(30,0)")


def lines_of(docs: DataFrame, use: Settings) -> DataFrame:
    """Lines that take part: document, number, text, place in the corpus, and 128 bits of hash."""
    rows = docs.select(document_key(docs).alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    long = F.length("line") >= use.min_chars
    return rows.filter(long | F.col("line").rlike(r"[\p{L}\p{N}]") if use.short_repeats else long).select(
        "doc", "n", "line",
        (F.col("doc") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("n")).cast("decimal(38,0)").alias("place"),
        F.xxhash64("line").alias("id"),
        F.xxhash64(F.lit(1), "line").alias("id2"),
    )


def classes_of(lines: DataFrame) -> DataFrame:
    """Classes of equal lines: first place and size; combined before the shuffle."""
    return lines.groupBy("id", "id2").agg(F.min("place").alias("first"), F.count("*").alias("size"))


def first_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """One line of each class; ``repeated`` are the classes of several lines."""
    known = maybe_broadcast(repeated.select("id", "id2", "first"))
    kept = lines.join(known, ["id", "id2"], "left").filter("first is null or first = place")
    return kept.select("id", "place", "line")


# --- segment join ----------------------------------------------------------------------------------


def parts_of(threshold: int) -> list[tuple[int, int, int]]:
    """(less, segment, shift) of the substrings of a line that may be a segment of an indexed line.

    The indexed line has ``less`` fewer characters; ``shift`` is how far the substring lies from the place
    of the segment there.  Edits before it and after it add up to the threshold at most, which bounds it.
    Without either it is the line's own segment, which is indexed.
    """
    return [
        (less, i, shift)
        for less in range(threshold + 1)
        for i in range(threshold + 1)
        for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)
    ]


def _span(size: Column, part: tuple[int, int, int], threshold: int) -> tuple[Column, Column]:
    """Start from 0 and length of a part of a line of ``size`` characters."""
    less, i, shift = part
    start, end = (
        F.call_function("div", (size - less) * j, F.lit(threshold + 1)).cast("int") for j in (i, i + 1)
    )
    return start + shift, end - start


def members(rows: DataFrame, threshold: int, shortest: int = 0) -> DataFrame:
    """(key, id, indexed, space, part, only) of the parts that meet another line's segment.

    ``rows`` are (id, rest, space), of at least ``shortest`` characters.  Each row meets one row for its key,
    not its lines, so there are no more rows out than in.  ``only`` is the line of a segment that just one
    line has; it has no row of its own.  Substrings are taken from UTF-32, where they need no search for
    their start.
    """
    all_parts = parts_of(threshold)
    own = [str(n) for n, (less, _, shift) in enumerate(all_parts) if not less and not shift]
    coded = rows.withColumn("code", F.encode("rest", "UTF-32"))
    coded = coded.withColumn("size", F.shiftright(F.octet_length("code"), 2))
    size = F.col("size")

    def key(part: tuple[int, int, int]) -> Column:
        start, long = _span(size, part, threshold)
        found = F.xxhash64("space", size - part[0], F.lit(part[1]), F.substring("code", 4 * start + 1, 4 * long))
        if shortest >= (threshold + 1) ** 2 + threshold:
            return found
        return F.when((start >= 0) & (long > 0) & (size > part[0]), found)

    def keyed(names: list[str]) -> DataFrame:
        wide = coded.select("id", "space", *[key(all_parts[int(n)]).alias(n) for n in names])
        return wide.unpivot(["id", "space"], names, "part", "key").filter("key is not null")

    indexed = keyed(own).groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"))
    every = keyed([str(n) for n in range(len(all_parts))]).withColumn("part", F.col("part").cast("int"))
    met = every.join(indexed.hint("shuffle_hash"), "key").filter("id != lead or id != last")
    return met.select(
        "key", "id", F.col("part").isin([int(n) for n in own]).alias("indexed"), "space", "part",
        F.when(F.col("lead") == F.col("last"), F.col("lead")).alias("only"),
    )


def without_part(rest: Column, part: Column, threshold: int) -> Column:
    """A text without one of its parts, with a line break in its place."""
    size = F.length(rest)
    spans = [_span(size, p, threshold) for p in parts_of(threshold)]
    start, long = (F.get(F.array(*[x[k] for x in spans]), part) for k in (0, 1))
    return F.concat(F.substring(rest, F.lit(1), start), F.lit("\n"), F.substring(rest, start + long + 1, size))


def letter_counts(line: Column) -> list[Column]:
    """Counts of the Latin letters modulo 16, four bits each, in two numbers."""

    def count(letter: str) -> Column:
        return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))).cast("bigint")

    return [
        reduce(
            Column.bitwiseOR,
            [F.shiftleft(count(c).bitwiseAND(F.lit(15)), 4 * i) for i, c in enumerate(letters)],
        )
        for letters in (ascii_lowercase[:15], ascii_lowercase[15:])
    ]


def letters_allow(a: list[str], b: list[str], threshold: int) -> Column:
    """Whether letter counts (modulo 16) are as near as so many edits leave them: two for each edit."""

    def apart(x: Column, y: Column, i: int) -> Column:
        d = (F.shiftright(x, 4 * i) - F.shiftright(y, 4 * i)).bitwiseAND(F.lit(15))
        return F.least(d, 16 - d)

    parts = [apart(F.col(x), F.col(y), i) for x, y, n in zip(a, b, (15, 11)) for i in range(n)]
    return reduce(Column.__add__, parts) <= 2 * threshold


def _pairs(met: DataFrame, letters: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b), a < b, that share a key where one of them is indexed and whose letters allow it."""
    alone = met.filter("only is not null").select("key", F.col("only").alias("id"), F.lit(True).alias("indexed"))
    known = met.select("key", "id", "indexed").union(alone).distinct().join(letters, "id")
    side = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("key", "id", "indexed", "l1", "l2")]
    left, right = known.select(*side("x")), known.filter("indexed").select(*side("y"))
    once = (F.col("x_id") != F.col("y_id")) & (~F.col("x_indexed") | (F.col("x_id") < F.col("y_id")))
    near = letters_allow(["x_l1", "x_l2"], ["y_l1", "y_l2"], threshold)
    met = left.join(right, (F.col("x_key") == F.col("y_key")) & once & near)
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def deletions(rest: Column, threshold: int) -> Column:
    """All strings left after up to ``threshold`` deletions, with repeats."""
    out = F.array(rest)
    for _ in range(threshold):
        shorter = F.flatten(
            F.transform(
                out,
                lambda s: F.transform(
                    F.sequence(F.lit(0), F.length(s)),  # 0 leaves the string whole
                    lambda i: F.when(i == 0, s).otherwise(
                        F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
                    ),
                ),
            )
        )
        out = F.array_distinct(shorter)
    return out


def candidate_pairs(lines: DataFrame, use: Settings) -> DataFrame:
    """Pairs of lines that may lie within the threshold; none that does is missing.

    ``lines`` is a stored table of (id, line).
    """
    rows = lines.select("id", F.col("line").alias("rest"), F.lit(0).cast("bigint").alias("space"))
    found, letters = [], None
    while True:
        met = stage(members(rows, use.threshold, min(use.min_chars, use.short + 1)), "members")
        if letters is None:  # of the few lines that share anything
            ids = stage(met.select("id").union(met.select("only")).distinct(), "sharing")
            sharing = lines.join(maybe_broadcast(ids), "id", "left_semi")
            l1, l2 = letter_counts(F.col("line"))
            letters = stage(sharing.select("id", l1.alias("l1"), l2.alias("l2")), "letters")
        crowded = met.filter("indexed").groupBy("key").count().filter(F.col("count") > use.hot)
        hot = stage(crowded.select("key"), "hot-segments")
        few = maybe_broadcast(hot)
        found.append(_pairs(met.join(few, "key", "left_anti"), letters, use.threshold))
        if hot.isEmpty():
            break
        refined = met.join(few, "key", "left_semi").join(rows, ["id", "space"])
        rest = without_part(F.col("rest"), F.col("part"), use.threshold)
        rows = stage(refined.select("id", rest.alias("rest"), F.col("key").alias("space")).distinct(), "refined")
        # Rests of about this length go both ways, so that no pair is parted.
        short = rows.filter(F.length("rest") <= use.short + use.threshold)
        variants = short.select("id", "space", F.explode(deletions(F.col("rest"), use.threshold)).alias("v"))
        variants = variants.select("id", F.lit(True).alias("indexed"), F.xxhash64("space", "v").alias("key"))
        variants = variants.withColumn("only", F.lit(None).cast("bigint"))
        found.append(_pairs(variants, letters, use.threshold))
        rows = rows.filter(F.length("rest") > use.short)
        if rows.isEmpty():
            break
    return stage(reduce(DataFrame.unionByName, found).distinct(), "pairs")


# --- verification ----------------------------------------------------------------------------------


def equal_start(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts, by halving steps."""

    def longer(so_far: Column, power: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), power)
        same = F.substring(a, so_far + 1, step) == F.substring(b, so_far + 1, step)
        fits = so_far + step <= F.least(F.length(a), F.length(b))
        return F.when(fits & same, so_far + step).otherwise(so_far)

    return F.aggregate(F.sequence(F.lit(24), F.lit(0), F.lit(-1)), F.lit(0), longer)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two arrays of characters if it is at most ``threshold``, else some number above.

    Bit r of the band stands for row j - threshold + r of column j.  A column without any diagonal that
    stays equal adds one to all of them; after more than ``threshold`` of those nothing is worked out any
    more.  The lengths must differ by no more than the threshold, and ``a`` must be longer than it.
    """
    k, width = threshold, 2 * threshold + 1
    mask = (1 << width) - 1
    bit = lambda x, r: F.shiftright(x, r).bitwiseAND(F.lit(1))

    def inverse(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def matched(s: Column, j: Column) -> Column:
        letter = F.get(b, j - 1)
        same = [
            F.when((j - k + r >= 1) & (F.get(a, F.greatest(j - k + r - 1, F.lit(0))) == letter), 1 << r).otherwise(0)
            for r in range(width)
        ]
        eq = reduce(Column.bitwiseOR, same).cast("bigint")
        vp, vn = s["vp"], s["vn"]
        carried = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        d0 = carried.bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        return F.struct(s.alias("s"), d0.alias("d0"), j.alias("j"))

    def advance(x: Column) -> Column:
        s, d0 = x["s"], x["d0"]
        hp = s["vn"].bitwiseOR(inverse(d0.bitwiseOR(s["vp"])))
        hn = d0.bitwiseAND(s["vp"])
        row = (F.size(a) - x["j"] + k).cast("int")  # the bit of the last row of ``a``
        along = F.lit(0)
        for r in range(width):
            along = F.when(row == r, bit(hp, r) - bit(hn, r)).otherwise(along)
        lower = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(inverse(lower.bitwiseOR(hp))).alias("vp"),
            lower.bitwiseAND(hp).alias("vn"),
            (s["score"] + F.when(row >= 2 * k, 1 - bit(d0, 2 * k)).otherwise(along)).cast("bigint").alias("score"),
            (s["misses"] + (d0 == 0).cast("int")).alias("misses"),
        )

    start = F.struct(
        F.lit(((1 << (k + 1)) - 1) << k).cast("bigint").alias("vp"),
        F.lit(0).cast("bigint").alias("vn"),
        F.lit(k).cast("bigint").alias("score"),
        F.lit(0).alias("misses"),
    )

    def step(s: Column, j: Column) -> Column:
        # A one-element transform binds the first half of a step, so that it is worked out once.
        return F.when(s["misses"] > k, s).otherwise(F.get(F.transform(F.array(matched(s, j)), advance), 0))

    return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: F.greatest(s["score"], s["misses"]))


def linked(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """Verified links with the places of both lines."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stage(
        lines.select("id", "place", "line").join(maybe_broadcast(stage(ids, "paired")), "id", "left_semi"),
        "paired-lines",
    )
    side = lambda c: texts.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place"), F.col("line").alias(f"{c}_line"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.abs(F.length("a_line") - F.length("b_line")) <= threshold

    # Bound by one-element transforms, as a lambda works out what it names anew in each step.
    def bound(values: Column, then) -> Column:
        return F.get(F.transform(F.array(values), then), 0)

    def cut(at: Column) -> Column:  # equal starts change nothing but take time; a few characters stay
        begin = F.greatest(at - threshold, F.lit(1))
        letters = [F.split(F.substring(c, begin, F.length(c)), "").alias(c) for c in ("a_line", "b_line")]
        return bound(F.struct(*letters), lambda x: banded_distance(x["a_line"], x["b_line"], threshold))

    distance = bound(equal_start(F.col("a_line"), F.col("b_line")), cut)
    return met.filter(F.when(near, distance <= threshold).otherwise(False)).select("a", "b", "a_place", "b_place")


# --- what goes -------------------------------------------------------------------------------------


def marked_classes(docs: DataFrame, use: Settings) -> DataFrame:
    """Classes of which lines go: (id, id2, first, near), near if even the first has an earlier neighbour."""
    lines = lines_of(docs, use)
    classes = stage(classes_of(lines), "line-classes")
    repeated = classes.filter("size > 1")
    firsts = stage(first_lines(lines.filter(F.length("line") >= use.min_chars), repeated), "first-lines")
    links = linked(candidate_pairs(firsts, use), firsts, use.threshold)
    later = F.when(F.col("a_place") < F.col("b_place"), F.struct(F.col("b").alias("id"), F.col("b_place").alias("first")))
    later = later.otherwise(F.struct(F.col("a").alias("id"), F.col("a_place").alias("first")))
    near = links.filter("a_place != b_place").select(later.alias("x")).select("x.*").distinct()
    near = stage(near, "near-lines").withColumn("near", F.lit(True))
    marked = classes.join(maybe_broadcast(near), ["id", "first"], "left")
    return marked.filter("size > 1 or near").select(
        "id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")
    )


def dropped_lines(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """(doc, dropped): numbers from 0 of the lines that go, for documents that lose any."""
    marked = stage(marked_classes(docs, use), "marked-lines")
    lines = lines_of(docs, use).drop("line")
    gone = lines.join(maybe_broadcast(marked), ["id", "id2"]).filter("near or place != first")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("n")).alias("dropped"))


def _sent(gone: DataFrame) -> DataFrame:
    """Marked for broadcast if the rows and the line numbers in them are few enough."""
    numbers = gone.agg(F.sum(F.size("dropped"))).first()[0] or 0
    return maybe_broadcast(gone) if numbers <= SENT_NUMBERS else gone


def report(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: number of lines, of dropped lines, and which ones."""
    gone = _sent(settled(docs.sparkSession, "dropped", lambda: dropped_lines(docs, use)))
    none = F.array().cast("array<int>")
    rows = docs.select(
        document_key(docs).alias("doc"), "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
    )
    return rows.join(gone, "doc", "left").select(
        "doc_id",
        F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(0).alias("n_lines"),
        F.size(F.coalesce("dropped", none)).cast("bigint").alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"),
    )


def without_repeats(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """``docs`` without the dropped lines, and without documents of which next to nothing is left.

    Columns stay; ``n_chars``, if there is one, follows the text.
    """
    gone = _sent(settled(docs.sparkSession, "dropped", lambda: dropped_lines(docs, use)))
    key, marks, left = (fresh_name(docs, c) for c in ("line_key", "dropped", "left"))
    rows = docs.withColumn(key, document_key(docs)).join(
        gone.select(F.col("doc").alias(key), F.col("dropped").alias(marks)), key, "left"
    )
    untouched = F.col(marks).isNull()

    def joined(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(marks))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    bound = F.transform(F.array(F.split("text", "\n")), joined)  # so that the text is split once
    rows = rows.withColumn(left, F.when(~untouched, F.get(bound, 0)))
    enough = untouched | (F.length(F.trim(left)) >= LEAST_LEFT * F.length("text"))
    shorter = {"text": F.when(untouched, F.col("text")).otherwise(F.col(left))}
    if "n_chars" in docs.columns:
        own = docs.schema["n_chars"].dataType
        shorter["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(F.length(left)).cast(own)
    return rows.filter(enough).withColumns(shorter).select(docs.columns)
