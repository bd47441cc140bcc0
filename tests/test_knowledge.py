import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from parcelflow.functions import vectors as V
from parcelflow.operators.chunks import chunk_text
from parcelflow.operators import similarity
from parcelflow.operators.similarity import collect_hits, small_chunk_hits, topk
from parcelflow.plans import knowledge
from parcelflow.sources.knowledge import overwrite_chunks, read_chunks, read_markdown


def windows(text, size, overlap):
    step, out, start = size - overlap, [], 0
    while start < len(text):
        out.append(text[start:start + size].strip())
        if start + size >= len(text):
            break
        start += step
    return [w for w in out if w]


@pytest.mark.parametrize("size, overlap", [(1000, 200), (10, 0), (10, 7), (7, 3), (1, 0), (100, 99)])
def test_chunks_equal_character_windows(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", " ", "x" * size, "y" * (size + 1), "😀é" * size] + [
        "".join(rng.choices("ab \n😀", k=rng.randint(1, 6 * size))) for _ in range(40)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {}
    for r in chunk_text(docs, size=size, overlap=overlap).collect():
        found.setdefault(r["i"], {})[int(r["chunk_id"])] = r["text"]
    for i, t in enumerate(texts):
        assert [found.get(i, {})[k] for k in sorted(found.get(i, {}))] == windows(t, size, overlap)


def test_chunk_counts_per_file_and_in_total(spark):
    lengths = {"a.md": 3574, "b.md": 1998, "c.md": 1602,
               "d.md": 1117, "e.md": 1168}
    files = spark.createDataFrame(
        [(s, "x" * n, None) for s, n in lengths.items()], "source string, text string, carrier string"
    )
    counts = {r["source"]: r["chunks"] for r in knowledge.ingest_counts(knowledge.chunk_files(files)).collect()}
    assert counts == {"a.md": 5, "b.md": 3, "c.md": 2,
                      "d.md": 2, "e.md": 2, None: 14}


def test_overlap_must_stay_below_size(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk_text(spark.createDataFrame([("x",)], "text string"), size=10, overlap=10)


@F.pandas_udf(ArrayType(FloatType()))
def letters(texts):
    return texts.map(lambda t: [float(t.count(c)) for c in "abc"])


def test_ingest_and_search(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    for name, text in {"Company_A_faq.md": "aaa" * 400, "b_shipping_b.md": "bbb", "README.md": "ccc",
                       "blank.md": " \n", "other.md": "\n ccc é \n"}.items():
        (folder / name).write_text(text, encoding="utf-8")
    files = {r["source"]: (r["text"], r["carrier"]) for r in read_markdown(spark, f"{folder}/*.md").collect()}
    assert files == {"Company_A_faq.md": ("aaa" * 400, "Shipping_A"), "b_shipping_b.md": ("bbb", "Shipping_B"),
                     "other.md": ("ccc é", None)}
    path = str(tmp_path / "chunks")
    assert read_chunks(spark, path).count() == 0
    counts = knowledge.ingest(spark, f"{folder}/*.md", path, letters)
    assert {r["source"]: r["chunks"] for r in counts.collect()} == {
        "Company_A_faq.md": 2, "b_shipping_b.md": 1, "other.md": 1, None: 4}
    chunks = read_chunks(spark, path)
    assert not overwrite_chunks(chunks.limit(0), str(tmp_path / "none"))
    queries = spark.createDataFrame(
        [(1, [0.0, 1.0, 0.1], "Shipping_A"), (2, [0.0, 0.0, 1.0], "Shipping_X"), (3, [1.0, 0.0, 0.0], None)],
        "query_id int, vec array<float>, carrier string",
    )
    best = {r["query_id"]: r for r in knowledge.search_kb(queries, chunks, 1).collect()}
    assert best[1]["source"] == "Company_A_faq.md" and best[2]["source"] == "other.md"
    assert best[3]["chunk_id"] == "0" and best[3]["score"] == 1.0
    assert {r["query_id"]: r["source"] for r in knowledge.search(queries, chunks, 1).collect()}[1] == "b_shipping_b.md"


def brute_force(queries, chunks, k):
    present = {c[2] for c in chunks}
    out = {}
    for q, vec, carrier in queries:
        limit = carrier if carrier in present and carrier is not None else None
        scored = []
        for source, chunk_id, c, v in chunks:
            if limit is None or c == limit:
                n = np.linalg.norm(vec) * np.linalg.norm(v)
                scored.append((-round(float(np.dot(vec, v) / n) if n else 0.0, 9), source, chunk_id))
        out[q] = [(s, c) for _, s, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("way", ["chunks held", "queries held", "blocks"])
def test_topk_equals_brute_force(spark, way):
    rng = np.random.default_rng(4)
    hot = [1.0, 2.0, 3.0, 4.0]  # a third of the chunks are copies of one vector
    chunks = [
        (f"s{i % 7}", str(i), ["A", "B", None][i % 3], hot if i % 3 == 0 else rng.normal(size=4).round(2).tolist())
        for i in range(150)
    ] + [("zero", "0", "A", [0.0] * 4)]
    queries = [(i, rng.normal(size=4).round(2).tolist(), ["A", "B", "C", None][i % 4]) for i in range(40)]
    queries.append((99, hot, None))
    q = spark.createDataFrame(queries, "query_id int, vec array<double>, carrier string").repartition(3)
    c = spark.createDataFrame(chunks, "source string, chunk_id string, carrier string, vec array<double>").repartition(5)
    limits = {"chunks held": 1000, "queries held": 60, "blocks": 5}
    found = {}
    for r in topk(q, c, 6, max_broadcast=limits[way], block=16).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["source"], r["chunk_id"])
    expected = brute_force(queries, chunks, 6)
    assert {i: [hits[n] for n in sorted(hits)] for i, hits in found.items()} == expected
    if way == "chunks held":
        texts = c.withColumn("text", F.concat(F.lit("t"), "chunk_id"))
        find = small_chunk_hits(texts, 6)
        held = {r["query_id"]: r["hits"] for r in q.select("query_id", find("vec", "carrier").alias("hits")).collect()}
        assert {i: [(h["source"], h["chunk_id"]) for h in hs] for i, hs in held.items()} == expected
        assert all(h["text"] == "t" + h["chunk_id"] for hs in held.values() for h in hs)
        joined = {r["query_id"]: r["hits"] for r in collect_hits(topk(q, c, 6), texts).collect()}
        assert joined == held
        assert small_chunk_hits(texts, 6, max_broadcast=10) is None


def test_null_vectors_get_no_hits(spark):
    chunks = spark.createDataFrame([("s", "1", None, "t", [1.0, 0.0])],
                                   "source string, chunk_id string, carrier string, text string, vec array<double>")
    rows = spark.createDataFrame([(1, None), (2, [0.5, 0.5])], "i int, vec array<double>")
    find = small_chunk_hits(chunks, 3)
    sizes = {r["i"]: len(r["h"]) for r in rows.select("i", find("vec", F.lit(None).cast("string")).alias("h")).collect()}
    assert sizes == {1: 0, 2: 1}


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    out = row.select(V.cosine("a", "b"), V.cosine("a", "z"), V.normalize(F.col("a")), V.normalize(F.col("z"))).first()
    assert out[0] == pytest.approx(0.96) and out[1] == 0.0 and out[2] == pytest.approx([0.6, 0.8]) and out[3] == [0.0, 0.0]


def lengths(text):
    return F.array(F.char_length(text).cast("float"), F.crc32(text.cast("binary")).cast("float"))


def test_an_ingest_costs_what_changed(spark, tmp_path):
    from parcelflow.plans.knowledge import ingest_changes
    from parcelflow.sources import knowledge as K

    path = str(tmp_path / "kb")
    columns = "source string, chunk_id string, text string, carrier string"
    first = [(f"{c}.md", str(i), f"text {c} {i % 4}", c) for c in ("A", "B", "C") for i in range(6)]
    first += [("plain.md", "0", "text A 1", None)]

    def state(version=None):
        return sorted(tuple(r) for r in read_chunks(spark, path, version).select("source", "chunk_id", "text", "carrier").collect())

    done = ingest_changes(spark.createDataFrame(first, columns), path, lengths)
    assert (done.chunks, done.embedded, done.carriers) == (19, 12, (None, "A", "B", "C"))
    assert state() == sorted(first)
    old_reader = read_chunks(spark, path)
    again = ingest_changes(spark.createDataFrame(first, columns), path, lengths)
    assert (again.embedded, again.carriers, K.versions(spark, path)) == (0, (), [1])

    second = [r for r in first if r[0] != "C.md"]  # a carrier goes, a chunk changes, another gets a known text
    second[0], second[7] = ("A.md", "0", "a new text", "A"), ("B.md", "1", "text A 3", "B")
    before = K.carrier_folders(spark, path)
    done = ingest_changes(spark.createDataFrame(second, columns), path, lengths)
    assert (done.embedded, done.carriers) == (1, ("A", "B", "C"))
    after = K.carrier_folders(spark, path)
    assert after[None] == before[None] and after["A"] != before["A"] and "C" not in after
    assert state() == sorted(second) and state(1) == sorted(first)
    rows = read_chunks(spark, path).collect()
    assert all(r["vec"][0] == len(r["text"]) for r in rows)
    # Who opened the table before the change still reads what was there.
    assert old_reader.count() == 19
    K.remove_old_states(spark, path, keep=1)
    assert state() == sorted(second) and K.versions(spark, path) == [2]

    gone = ingest_changes(spark.createDataFrame([], columns), path, lengths)
    assert gone.chunks == 0 and state() == []


def test_two_writers_of_one_state(spark, tmp_path, monkeypatch):
    from parcelflow.sources import knowledge as K

    path = str(tmp_path / "kb")
    chunks = spark.createDataFrame([("a.md", "0", "t", None, "A")], "source string, chunk_id string, text string, vec array<float>, carrier string")
    assert overwrite_chunks(chunks, path)
    monkeypatch.setattr(K, "versions", lambda s, p: [])  # did not see the other's
    with pytest.raises(RuntimeError, match="another writer"):
        K.replace_carriers(chunks, path)


@pytest.mark.parametrize("tile", [(3, 8), (256, 2048)])
def test_tiles_keep_the_best_and_the_order_of_ties(monkeypatch, tile):
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "RESCORED", 5)
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(300, 6)).astype(np.float32)
    vecs[50:200] = vecs[50] * rng.integers(1, 4, size=(150, 1))  # copies of other lengths
    vecs[7] = 0
    carriers = [["A", None, "B"][i % 3] for i in range(300)]
    rows = pa.table({"vec": pa.array(vecs.tolist(), pa.list_(pa.float32())), "carrier": pa.array(carriers, pa.string())})
    asked = rows.slice(0, 60)
    for k in (1, 4, 400):
        query, chunk, score = similarity._best(similarity._Vectors(asked), similarity._Vectors(rows), k)
        lengths = np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
        unit = vecs.astype(float) / np.where(lengths > 0, lengths, 1.0)
        for q in range(60):
            seen = [i for i in range(300) if carriers[q] in (None, carriers[i])]
            wanted = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in seen)[:k]
            found = list(zip((-score[query == q]).tolist(), chunk[query == q].tolist()))
            assert [i for _, i in found] == [i for _, i in wanted]
            assert np.allclose([s for s, _ in found], [s for s, _ in wanted])


def test_many_small_vectors_are_held(spark):
    """What tasks hold is a matter of bytes, not of rows."""
    chunks = spark.range(10_001).select(
        F.lit("s").alias("source"), F.col("id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("carrier"),
        F.lit("t").alias("text"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"),
    )
    find = small_chunk_hits(chunks, 1)
    far = spark.range(1).select(find(F.array(F.lit(1.0), F.lit(0.0)), F.lit(None).cast("string")).alias("hits")).first()
    assert [h["chunk_id"] for h in far["hits"]] == ["10000"]


def test_queries_of_one_file_are_dealt_over_tasks(spark):
    one = spark.range(100).coalesce(1).select(
        F.col("id").alias("query_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec")
    )
    chunks = one.select(F.lit("s").alias("source"), F.col("query_id").alias("chunk_id"), "vec")
    tasks = topk(one, chunks, 2).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_blocks_that_meet_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ROWS_OF_GROUP", 10)
    queries = spark.range(2000).selectExpr("id query_id", "array(cast(cos(id) as float), cast(sin(id) as float)) vec")
    chunks = spark.range(300).selectExpr(
        "'s' source", "cast(id as string) chunk_id", "array(cast(cos(id / 7) as float), cast(sin(id / 7) as float)) vec"
    )
    groups, meet = spark.sparkContext.accumulator(0), similarity._hits

    def counted(*args):
        groups.add(1)
        return meet(*args)

    monkeypatch.setattr(similarity, "_hits", counted)
    found = sorted(topk(queries, chunks, 3, max_broadcast=10).collect())
    assert groups.value >= similarity.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(similarity, "_hits", meet)
    assert found == sorted(topk(queries, chunks, 3).collect())


def test_blocks_send_a_query_once_however_many_chunks_there_are(spark, monkeypatch):
    """Ids that repeat or are null are questions of their own, and a block of queries meets chunks in small portions."""
    queries = spark.range(400).selectExpr(
        "nullif(id % 390, 7) query_id", "if(id % 3 = 0, 'A', null) carrier",
        "array(cast(cos(id % 390) as float), cast(sin(id % 390) as float)) vec",
    )
    chunks = spark.range(300).selectExpr(
        "'s' source", "cast(id as string) chunk_id", "if(id % 2 = 0, 'A', 'B') carrier",
        "array(cos(id / 7), sin(id / 7)) vec",
    )
    sent, by_block = spark.sparkContext.accumulator(0), similarity._by_block

    def counted(batches):
        for table in by_block(batches):
            sent.add(sum(table["is_query"].to_pylist()))
            yield table

    monkeypatch.setattr(similarity, "ROWS_OF_GROUP", 50)
    monkeypatch.setattr(similarity, "_by_block", counted)
    key = lambda r: (r["query_id"] is not None, r["query_id"] or 0, r["rank"])
    found = sorted(topk(queries, chunks, 3, max_broadcast=10, block=20).collect(), key=key)
    assert sent.value == 400
    alone = spark.range(390).selectExpr(
        "id query_id", "if(id % 3 = 0, 'A', null) carrier", "array(cast(cos(id) as float), cast(sin(id) as float)) vec"
    ).filter("id >= 10 and id <> 7")
    wanted = sorted(topk(alone, chunks, 3).collect(), key=key)
    assert [r for r in found if (r["query_id"] or 0) >= 10] == wanted
    assert all(sum(r["query_id"] == q for r in found) == 3 for q in (None, 0, 9))
