"""Merkle manifest of a dataset: a leaf per document, runs of sixteen hashed level by level.

Each level is a table of nodes (tree, slot in the level, width of the level, hash).  In a window over the run of a
node, lag and lead columns of fixed offsets, masked by the slot in the run and the length of the run, are its
siblings; the row of the first child hashes the parent.  On the way down a node's path is its own siblings and the
path of its parent, which gives every document a proof that can be folded up to the root.

A tree is a source; the hashes of the sources are the leaves of one more tree.  Rows are placed in a source by
ranges (``places``), so a source of any size lies in many tasks, and runs never hold more than sixteen rows.

Nulls hash as ``-``, so they differ from empty texts; documents without a source are a tree of their own, the first.
Equal ids are ordered by their leaf, null ids come first.  Repeated rows are leaves each.  Texts are hashed
whole, of any length.  Other columns do not matter, whatever their names.  An empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.staging import stage

from .places import places

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes hashed to one parent.
RUN = 16


def leaf_hash(*values: Column) -> Column:
    """Hash of a row: each value with its length in bytes, so that no two rows of values look alike."""
    written = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in (value.cast("string") for value in values)
    ]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def with_siblings(level: DataFrame) -> DataFrame:
    """Nodes with the hashes of their siblings to the ``left`` and to the ``right``, each joined to one text."""
    run = Window.partitionBy("tree", "run").orderBy("at")
    slot = F.col("at") % RUN
    length = F.least(F.lit(RUN), F.col("width") - (F.col("at") - slot))
    none = F.lit("")
    left = [F.when(slot >= k, F.lag("hash", k).over(run)).otherwise(none) for k in range(RUN - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("hash", k).over(run)).otherwise(none) for k in range(1, RUN)]
    return level.withColumn("run", F.expr(f"at div {RUN}")).select(
        "*", F.concat(*left).alias("left"), F.concat(*right).alias("right")
    )


def parents(level: DataFrame) -> DataFrame:
    """The next level of the trees that have more than one node, hashed by the rows of first children."""
    first = with_siblings(level.filter("width > 1").select("tree", "at", "width", "hash")).filter(f"at % {RUN} = 0")
    return first.select(
        "tree",
        F.col("run").alias("at"),
        F.expr(f"(width + {RUN - 1}) div {RUN}").alias("width"),
        F.sha2(F.concat("hash", "right").cast("binary"), 256).alias("hash"),
    )


def grown(leaves: DataFrame) -> list[DataFrame]:
    """All levels over a written table of leaves (tree, at, width, hash), each written."""
    widest = leaves.agg(F.max("width")).first()[0] or 0
    levels = [leaves]
    while widest > 1:
        levels.append(stage(parents(levels[-1]), "level"))
        widest = -(-widest // RUN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node (tree, hash) of every tree."""
    out = [level.filter("width = 1").select("tree", "hash") for level in levels]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest level with ``path``, an array of (left, right) from the leaf up, and ``top``.

    ``above`` (tree, top, path) tells what stands over the last node of each tree.  Paths are handed down from
    parents to children; siblings are looked up in each level, by the same exchange as the parent.
    """
    known = None
    for number, level in reversed(list(enumerate(levels))):
        last = level.filter("width = 1").join(above, "tree")
        if known is not None:
            own = F.array(F.struct("left", "right"))
            over = known.select("tree", F.col("at").alias("run"), F.col("path").alias("over"), "top")
            met = with_siblings(level.filter("width > 1")).join(over, ["tree", "run"])
            met = met.withColumn("path", F.concat(own, "over")).select(*level.columns, "top", "path")
            last = last.select(*level.columns, "top", "path").unionByName(met)
        known = stage(last.select("tree", "at", "top", "path"), "paths") if number else last
    return known.select(*levels[0].columns, "top", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(
        path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256)
    )


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, **checked: Column) -> DataFrame:
    """Every document with its leaf, the ``subroot`` of its source, the ``root`` and its ``path``.

    ``checked`` are further columns over the fields of documents, carried along.
    """
    # Sources in bytewise order; the mark keeps the missing one first and apart from the empty one.
    tree = F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit(""))
    rows = docs.select(*FIELDS).select("doc_id", tree.alias("tree"), leaf_hash(*map(F.col, FIELDS)).alias("hash"),
                                       *[c.alias(name) for name, c in checked.items()])
    leaves = stage(places(rows, ["tree"], ["doc_id", "hash"], "at", "width"), "leaves")
    levels = grown(leaves)
    sources = tops(levels).withColumn("whole", F.lit(""))
    sources = places(sources, ["whole"], ["tree"], "at", "width").withColumnsRenamed({"tree": "source", "whole": "tree"})
    above = grown(stage(sources, "subroots"))
    found = tops(above).first()
    root = F.lit(found["hash"] if found else None).cast("string")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    top = above[0].sparkSession.range(1).select(F.lit("").alias("tree"), root.alias("top"), empty.alias("path"))
    roots = stage(
        with_paths(above, top).select(F.col("source").alias("tree"), F.col("hash").alias("top"), "path"), "sources"
    )
    return with_paths(levels, roots).select(
        "doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path", *checked
    )


def verified(proofs: DataFrame, leaf: Column) -> DataFrame:
    """Adds ``folded_root``, what ``leaf`` gives with the siblings of the path, and whether it is the root."""
    return proofs.withColumn("folded_root", folded(leaf, F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
