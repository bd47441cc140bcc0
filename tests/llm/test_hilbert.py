import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import hilbert as H


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"c{i}" for i in range(n)])
    df = df.select(*[F.col(c).cast("int") for c in df.columns])
    rows = df.withColumn("h", H.hilbert_index([F.col(c) for c in df.columns], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(cells)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def check_law(rows, texts, shards=24):
    sizes = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    in_order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in in_order] == sorted(r["curve"] for r in rows)


def test_shards_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = H.shard_rows(H.document_rows(docs)).collect()
    check_law(rows, texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))


def test_odd_rows(docs_of):
    docs = docs_of([(None, None), (None, ""), (5, "x"), (5, "x"), (5, "x"), (7, "y" * 100_000)] + [(9, "z")] * 50)
    docs = docs.withColumn("size", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    rows = H.shard_rows(H.document_rows(docs)).collect()
    check_law(rows, range(56))
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(8, 0)}
    assert H.shard_rows(H.document_rows(docs.limit(0))).count() == 0


def test_files_and_pruning(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files = H.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.drop("shard").collect()) == sorted(docs.collect())
    counts = {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
    assert counts == {r["shard"]: r["rows"] for r in files.collect()}
    wanted = [r["shard"] for r in H.shards_for(files, doc_id=(100, 120)).collect()]
    assert len(wanted) < 24
    assert set(r["shard"] for r in back.filter("doc_id between 100 and 120").collect()) <= set(wanted)


def test_equal_rows_are_cut_by_their_place(spark, docs_of, tmp_path):
    for n, rows in enumerate(([(5, "same")] * 48, [(5, "same")] * 40 + [(i, f"t{i}") for i in range(20)] + [(None, None)] * 9, [(1, "x")], [])):
        docs = docs_of(rows).withColumn("curve", F.lit("clash"))
        files = H.write_shards(docs, f"{tmp_path}/out{n}").collect()
        assert sum(r["rows"] for r in files) == len(rows)
        if rows:
            back = spark.read.parquet(f"{tmp_path}/out{n}")
            counts = {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()}
            assert counts == {r["shard"]: r["rows"] for r in files}
            assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == min(24, len(rows))
            assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.select(back.drop("shard").columns).collect()))
