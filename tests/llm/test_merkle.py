"""Merkle manifest against a plain tree, odd rows, many levels, and the query's SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parcelflow.llm import merkle

from .conftest import ODD_TEXTS


def digest(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def leaf_of(row):
    values = [None if v is None else str(v) for v in row]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    for level in levels[:-1]:
        start = at // 16 * 16
        yield level[start:at], level[at + 1:start + 16]
        at //= 16


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels, out = {}, []
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        levels[s] = levels_of([leaf_of(r) for r in trees[s]])
    above = levels_of([levels[s][-1][0] for s in order])
    for number, s in enumerate(order):
        for at, row in enumerate(trees[s]):
            path = [*path_of(levels[s], at), *path_of(above, number)]
            node = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf_of((*row[:4], lower))
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(h for left, right in path for h in (*left, *right)))
            root = above[-1][0]
            out.append((row[0], leaf_of(row), levels[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def written(spark, tmp_path, rows, extra=()):
    columns = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    df = spark.createDataFrame(rows, columns)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, entry.queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=repr)


def test_three_levels_many_sources_and_ties(spark, tmp_path):
    sources = [None, "", "a", "b", "é", "\U0001f600", "\uffee", *(f"s{i}" for i in range(30))]
    rows = [(i, "a", "en", i, f"Text {i}") for i in range(16 * 16 * 16 + 2)]
    rows += [(i, "b", None, None, "Same") for i in range(17)] + [(7, "b", None, None, "Other"), (7, "b", None, None, "Same")]
    rows += [(i, s, "de", 3, None) for i, s in enumerate(sources)]
    assert written(spark, tmp_path, rows) == plain(rows)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [(i, None, "en", 1, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, None, None, None, None), (None, "x", None, None, "A"), (None, "x", None, None, "B"), (-5, "x", "", 0, "")]
    extra = ["tree", "at", "width", "hash", "path", "left", "run", "place", "leaf", "top", "changed"]
    assert written(spark, tmp_path, rows, extra) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 17])
def test_small_tables(spark, tmp_path, n):
    rows = [(i, "only", "en", 1, f"T{i}") for i in range(n)]
    assert written(spark, tmp_path, rows) == plain(rows) if n else written(spark, tmp_path, rows) == []


def test_one_source_as_third_of_rows_lies_in_many_tasks(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.lit("en").alias("lang"), F.lit(1).cast("bigint").alias("n_chars"), F.lit("same").alias("text"),
    )
    found = merkle.verified(merkle.manifest(docs), F.col("leaf"))
    assert found.filter("verified").count() == 6000
    assert found.select("root").distinct().count() == 1 and found.select("subroot").distinct().count() == 51


def test_any_change_is_seen(spark, docs_of):
    docs = docs_of(["a", "b", None, ""])
    roots = {merkle.manifest(d).first()["root"] for d in (
        docs, docs.filter("doc_id < 3"), docs.withColumn("text", F.coalesce("text", F.lit(""))),
    )}
    assert len(roots) == 3
