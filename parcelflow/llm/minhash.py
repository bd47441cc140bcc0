"""Near-duplicate documents: MinHash with banding, verified, joined to components.

A document's set holds the hashes (64 bits) of its distinct shingles.  Documents with the same set are
one class and go on as one.  Many universal hash functions give the minima of the signature; bands of
them name buckets.  In a bucket every document is held against the one that shares most buckets with
others, which a group of near copies has at its centre; signatures are compared first, then the sets.  So a
group of any size costs as many pairs as it has documents.  What is linked by then needs no other pair.
Documents that are still apart are held against a centre of their own, and the rest against all documents
around the same centre, by what their sets have more and less than the centre's.  So no link between
different sets is lost but by the bands themselves: with 32 bands of 4 a pair at 0.8 shares none with a
chance of 5 in 100 million.

Null and empty texts, and texts without words, have an empty set and are linked with nothing.  Rows
without an id are not linked either: their component is null and they are kept.  Rows that repeat an id are
told apart by their text: each set is a class of its own, under a number that is no id.  Texts are taken whole, of
any length.  Of rows that share the smallest id of a group all are kept.  Empty tables give empty results; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parcelflow.staging import settled, stage

from .common import bounded_batches, fresh_name, maybe_broadcast, pieces, whole_texts, words_of
from .components import components
from .places import places


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; links from ``percent`` % similarity; ``bands`` of ``rows`` minima."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: Signatures that agree less than this share below ``percent`` rule a pair out (5 deviations).
    slack: float = 0.18


# --- sets and signatures ---------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a piece."""
    flat, doc = words_of(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)
    counts = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(counts)
    weights = _draw(words, 7) | np.uint64(1)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words if len(joined) else 0):
        joined += hashes[i : len(hashes) - words + 1 + i] * weights[i]
    joined = _mixed(joined)
    out = []
    for start, end in zip(ends - counts, ends):
        if end - start >= words:
            out.append(np.unique(joined[start : end - words + 1]))
        elif end > start:  # all words together, apart from longer shingles by the number of words
            few = hashes[start:end] * weights[: end - start]
            out.append(_mixed(np.array([few.sum(dtype=np.uint64) + np.uint64(end - start)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(members: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, a block of the set at a time."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 2048):
        values = factors[:, None] * members[None, i : i + 2048] + offsets[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


SKETCH = "struct<n: bigint, d1: bigint, d2: bigint, minima: array<int>>"
ARROW_SKETCH = pa.struct(
    [("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("minima", pa.list_(pa.int32()))]
)


def sketch(text: Column, use: Settings) -> Column:
    """Size, 128-bit digest and minima of a text's set; no minima for an empty set."""

    def sketched(texts: pa.Array) -> pa.Array:
        factors, offsets = (_draw(use.bands * use.rows, s) for s in (11, 13))
        factors |= np.uint64(1)
        out = []
        for piece in pieces(whole_texts(texts)):
            for members in shingle_sets(piece, use.words):
                digest = np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), "<i8")
                out.append(
                    {
                        "n": len(members), "d1": int(digest[0]), "d2": int(digest[1]),
                        "minima": signature(members, factors, offsets) if len(members) else None,
                    }
                )
        return pa.array(out, ARROW_SKETCH)

    return F.arrow_udf(sketched, SKETCH).asNondeterministic()(text)


def shingle_set(text: Column, words: int) -> Column:
    """A text's set as sorted numbers."""

    def listed(texts: pa.Array) -> pa.Array:
        sets = [s for p in pieces(whole_texts(texts)) for s in shingle_sets(p, words)]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))

    return F.arrow_udf(listed, "array<bigint>").asNondeterministic()(text)


# --- candidates ------------------------------------------------------------------------------------


def bands_of(classes: DataFrame, use: Settings) -> DataFrame:
    """(bucket, id): a row for each band of each class."""
    keys = [
        F.xxhash64(F.lit(b), *[F.get("minima", F.lit(b * use.rows + r)) for r in range(use.rows)])
        for b in range(use.bands)
    ]
    return classes.select("id", F.explode(F.array(*keys)).alias("bucket"))


def shared_buckets(classes: DataFrame, use: Settings) -> DataFrame:
    """(bucket, id, size) for buckets that several classes share."""
    bands = bands_of(classes, use)
    several = stage(bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    return stage(bands.join(maybe_broadcast(several), "bucket"), "members")


def agreeing(a: Column, b: Column) -> Column:
    """Share of minima that two signatures have in common."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return same / F.size(a)


def may_link(a: str, b: str, use: Settings) -> Column:
    """Whether sizes (n) and signatures (minima) of two sides leave a link possible."""
    n = F.least(f"{a}.n", f"{b}.n") * 100 >= use.percent * F.greatest(f"{a}.n", f"{b}.n")
    return n & (agreeing(F.col(f"{a}.minima"), F.col(f"{b}.minima")) >= use.percent / 100 - use.slack)


def sets_of(ids: DataFrame, texts: DataFrame, use: Settings) -> DataFrame:
    """(id, members) of the given classes, made anew from ``texts`` (id, text)."""
    wanted = texts.join(maybe_broadcast(stage(ids.distinct(), "wanted")), "id", "left_semi")
    return stage(wanted.select("id", shingle_set(F.col("text"), use.words).alias("members")), "sets")


def alike(both: Column, sizes: Column, use: Settings) -> Column:
    """Whether two sets with ``both`` common members and ``sizes`` members together are linked."""
    return both * 100 >= use.percent * (sizes - both)


def verified(pairs: DataFrame, sets: DataFrame, use: Settings) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}_set"))
    met = stage(pairs.distinct(), "pairs").join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("a_set", "b_set")).alias("both")
    counted = met.select("a", "b", both, (F.size("a_set") + F.size("b_set")).alias("sizes"))
    return stage(counted.filter(alike(F.col("both"), F.col("sizes"), use)).select("a", "b"), "links")


def star_links(rows: DataFrame, known: DataFrame, sets: DataFrame, use: Settings) -> DataFrame:
    """Links between the ids of ``rows`` (id, lead) and their leads; signatures are compared first."""
    met = rows.filter("id != lead").join(known, "id").alias("x").join(
        known.select(F.col("id").alias("lead"), "n", "minima").alias("y"), "lead"
    )
    near = met.filter(may_link("x", "y", use)).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    return verified(near, sets, use)


def best_of(rows: DataFrame, group: str, reach: DataFrame) -> DataFrame:
    """Per group the id that meets most others over all bands (of equal ones the smallest), as ``best``."""
    rank = F.struct("reach", (-F.col("id")).alias("minus_id"))
    best = rows.join(reach, "id").groupBy(group).agg(F.max(rank).alias("best"))
    return stage(best.select(group, (-F.col("best.minus_id")).alias("best")), "best")


def placed_in(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (id, lead) with the components of both: ``part`` and ``main``."""
    found = stage(components(links), "components")
    own = found.select(F.col("node").alias("id"), F.col("component").alias("part"))
    leads = found.select(F.col("node").alias("lead"), F.col("component").alias("main"))
    out = rows.join(own, "id", "left").join(leads, "lead", "left").select(
        "id", "lead", F.coalesce("part", "id").alias("part"), F.coalesce("main", "lead").alias("main")
    )
    return stage(out, "placed")


def links_of(classes: DataFrame, texts: DataFrame, use: Settings) -> DataFrame:
    """Links (a, b) that connect all classes that can be connected; ``classes``: (id, n, minima), stored."""
    members = shared_buckets(classes, use)
    known = classes.select("id", "n", "minima")
    reach = stage(members.groupBy("id").agg(F.sum("size").alias("reach")), "reach")

    # Held against the centre of its bucket.
    leads = best_of(members, "bucket", reach).withColumnRenamed("best", "lead")
    families = members.join(maybe_broadcast(leads), "bucket").select("id", "lead").distinct()
    families = stage(families, "families")
    sets = sets_of(families.select("id"), texts, use)
    links = star_links(families, known, sets, use)

    # Those it holds apart, against a centre of their own.
    strays = placed_in(families, links).filter("part != main")
    second = best_of(strays, "lead", reach)
    again = strays.join(maybe_broadcast(second), "lead").select("id", F.col("best").alias("lead")).distinct()
    links = stage(links.union(star_links(again, known, sets, use)), "links")

    # Those still apart, against all others that share the centre of a bucket with them.  What each set
    # has more and less than the centre's tells how two of them differ.
    placed = placed_in(families, links)
    open_leads = maybe_broadcast(stage(placed.filter("part != main").select("lead").distinct(), "open"))
    around = placed.join(open_leads, "lead", "left_semi").join(sets, "id").join(
        sets.select(F.col("id").alias("lead"), F.col("members").alias("centre")), "lead"
    )
    apart = F.concat(F.array_except("members", "centre"), F.array_except("centre", "members"))
    rows = around.select(
        "id", "lead", "part", F.size("members").alias("n"), apart.alias("apart"), (F.col("part") != F.col("main")).alias("stray")
    )
    rows = stage(rows.withColumn("d", F.size("apart")), "around")
    side = lambda c, df: df.select(*[F.col(x).alias(f"{c}_{x}") for x in df.columns])
    x, y = side("x", rows.filter("stray")), side("y", rows)
    sizes = F.col("x_n") + F.col("y_n")

    def near(least_apart: Column) -> Column:
        return alike((sizes - least_apart) / 2, sizes, use)

    exact = F.col("x_d") + F.col("y_d") - 2 * F.size(F.array_intersect("x_apart", "y_apart"))
    once = ~F.col("y_stray") | (F.col("x_id") < F.col("y_id"))
    met = x.join(
        y,
        (F.col("x_lead") == F.col("y_lead")) & (F.col("x_part") != F.col("y_part")) & once
        & F.when(near(F.abs(F.col("x_d") - F.col("y_d"))), near(exact)).otherwise(False),
    )
    crossed = met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
    return links.union(crossed.distinct())


# --- the operator ----------------------------------------------------------------------------------


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _numbered(firsts: DataFrame, docs: DataFrame, repeated: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Classes with a number of their own below ``low`` where their id has several rows, and the texts of all.

    ``firsts`` has a row for each class: doc_id, text_key, d1, d2, n, minima.
    """
    alone = maybe_broadcast(repeated)
    own = firsts.join(alone, "doc_id", "left_anti").withColumn("id", F.col("doc_id"))
    texts = docs.join(alone, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text")
    if repeated.isEmpty():
        return own, texts
    shared = firsts.join(alone, "doc_id", "left_semi").withColumn("whole", F.lit(""))
    numbered = places(stage(shared, "shared"), ["whole"], ["d1", "d2"], "at", "all")
    numbered = stage(numbered.withColumn("id", F.lit(low - 1) - F.col("at")).drop("whole", "at", "all"), "numbered")
    told = docs.join(alone, "doc_id", "left_semi").withColumn("text_key", _text_key(F.col("text")))
    told = told.join(numbered.select("doc_id", "text_key", "id"), ["doc_id", "text_key"]).select("id", "text")
    return own.unionByName(numbered), texts.unionByName(told.dropDuplicates(["id"]))


def _judged(docs: DataFrame, use: Settings) -> DataFrame:
    """``near_duplicates`` with ``text_key`` and whether the id of the row is ``repeated``."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    text_key = _text_key(F.col("text")).alias("text_key")
    sketched = docs.select("doc_id", text_key, sketch(F.col("text"), use).alias("s"))
    rows = stage(sketched.select("doc_id", "text_key", "s.*"), "sketches")
    ids = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count()
    repeated = stage(ids.filter("count > 1").select("doc_id"), "repeated")
    low = rows.agg(F.min("doc_id")).first()[0] or 0
    linkable = rows.filter("n > 0 and doc_id is not null")
    groups = linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = stage(groups.filter("copies > 1").drop("copies"), "copies")
    placed = linkable.join(maybe_broadcast(groups), ["d1", "d2"], "left")
    firsts = placed.filter("rep is null or rep = doc_id").drop("rep").dropDuplicates(["d1", "d2"])
    classes, texts = _numbered(firsts, docs, repeated, low)
    classes = stage(classes.select("id", "n", "minima", "doc_id", "d1", "d2"), "classes")
    found = settled(
        docs.sparkSession, "components",
        lambda: components(links_of(classes.select("id", "n", "minima"), texts, use)),
    )
    narrow = rows.select("doc_id", "text_key", "n", "d1", "d2")
    own = narrow.join(maybe_broadcast(groups), ["d1", "d2"], "left").withColumn(
        "id", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    )
    several = not repeated.isEmpty()
    if several:
        numbers = stage(classes.filter(F.col("id") < low).select("d1", "d2", F.col("id").alias("number")), "numbers")
        own = own.join(maybe_broadcast(numbers), ["d1", "d2"], "left")
        own = own.withColumn("id", F.when(F.col("n") > 0, F.coalesce("number", "id")).otherwise(F.col("id")))
    out = own.join(maybe_broadcast(found.withColumnRenamed("node", "id")), "id", "left")
    out = out.withColumn("part", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    if several:
        # Numbers lie below all ids, so a group with one is known by it and has its smallest id still to be found.
        out = stage(out.select("doc_id", "text_key", "n", "part"), "parts")
        tops = out.filter(F.col("part") < low).groupBy("part").agg(F.min("doc_id").alias("top"))
        out = out.join(maybe_broadcast(stage(tops, "tops")), "part", "left").withColumn("part", F.coalesce("top", "part"))
        out = out.join(maybe_broadcast(repeated.withColumn("repeated", F.lit(True))), "doc_id", "left")
    else:
        out = out.withColumn("repeated", F.lit(False))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("part").alias("component_id"),
        (F.col("part").isNull() | (F.col("doc_id") == F.col("part"))).alias("kept"),
        "text_key", F.coalesce("repeated", F.lit(False)).alias("repeated"),
    )


def near_duplicates(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    return _judged(docs, use).drop("text_key", "repeated")


def without_copies(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, columns as they are, without those that are not of the first id of their group.

    Where an id has several rows, a row goes only if its own text is such a copy.
    """
    key, text_key = fresh_name(docs, "gone_id"), fresh_name(docs, "gone_text")

    def copies() -> DataFrame:
        rows = _judged(docs, use).filter(~F.col("kept"))
        return rows.select(F.col("doc_id").alias(key), F.when(F.col("repeated"), F.col("text_key")).alias(text_key)).distinct()

    gone = settled(docs.sparkSession, "gone", copies)
    own_text = F.col(text_key).isNull() | (F.col(text_key) == _text_key(docs["text"]))
    return docs.join(maybe_broadcast(gone), (docs["doc_id"] == F.col(key)) & own_text, "left_anti")
