"""Inverted-file index: exact answers, recall on clustered vectors, crowded cells, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelflow.operators import similarity as S, vector_index as V
from parcelflow.operators.similarity import topk
from parcelflow.plans import knowledge, triage
from parcelflow.schemas import MESSAGES

SCHEMA = "source string, chunk_id string, carrier string, text string, vec array<float>"


def clustered(spark, n=1500, clusters=20, dim=12, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dim))
    return spark.createDataFrame(
        [
            (f"s{i % 5}", str(i), ["A", "B", None][i % 3], f"text {i}",
             (centres[i * 7 % clusters] + 0.3 * draw.normal(size=dim)).tolist())
            for i in range(n)
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks") / "c")
    clustered(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return V.build_index(chunks, str(tmp_path_factory.mktemp("index") / "i"))


def queries_of(chunks):
    wanted = F.when(F.col("chunk_id") % 20 == 0, "A").when(F.col("chunk_id") % 30 == 0, "no such carrier")
    rows = chunks.filter("chunk_id % 10 = 0")
    return rows.select(F.concat("source", F.lit("/"), "chunk_id").alias("query_id"), "vec", wanted.alias("carrier"))


def hits(df):
    return {(r["query_id"], r["rank"], r["source"], r["chunk_id"], round(r["score"], 7)) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 5}, {"probes": 1}])
def test_exact_search_is_topk(chunks, index, options):
    queries = queries_of(chunks)
    assert hits(V.search_index(queries, index, 4, exact=True, **options)) == hits(topk(queries, chunks, 4))


@pytest.mark.parametrize("max_broadcast", [10_000, 5])
def test_few_cells_hold_most_hits_of_clustered_vectors(chunks, index, max_broadcast):
    queries = queries_of(chunks)
    wanted = hits(topk(queries, chunks, 4))
    found = hits(V.search_index(queries, index, 4, max_broadcast=max_broadcast))
    assert index.probes <= len(index.centroids) / 4
    assert len(wanted & found) >= 0.9 * len(wanted)


def test_every_row_is_in_the_index(spark, chunks, index):
    stored = index.chunks(spark)
    assert stored.count() == index.sizes.sum() == chunks.count()
    again = V.load_index(spark, index.path)
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids)
    assert np.array_equal(again.sizes, index.sizes) and np.array_equal(again.reach, index.reach)


def test_only_probed_cells_are_read(spark, chunks, index):
    one = queries_of(chunks).drop("carrier").limit(1)
    found = V.search_index(one, index, 3, probes=2)
    cells = index.chunks(spark).join(found, ["source", "chunk_id"]).select("cell").distinct().count()
    assert cells <= 2
    asked = chunks.limit(1).selectExpr("'q' query_id", "cast(null as string) carrier", "vec", "0 cell")
    plan = V._visits(asked, index, 3, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_a_crowded_cell_meets_in_blocks(spark, tmp_path, monkeypatch):
    copies = clustered(spark, 300).withColumn("vec", F.when(F.col("chunk_id") % 3 != 0, F.array(*[F.lit(0.5)] * 12)).otherwise(F.col("vec")).cast("array<float>"))
    index = V.build_index(copies, str(tmp_path / "i"), cells=6)
    monkeypatch.setattr(V, "BLOCK_BYTES", 1)  # blocks of 1024 rows at least
    queries = queries_of(copies)
    assert hits(V.search_index(queries, index, 5, exact=True, max_broadcast=2)) == hits(topk(queries, copies, 5))


def test_odd_vectors(spark, tmp_path):
    rows = [("a", str(i), None, "t", [float(i % 3 - 1), 1.0]) for i in range(30)]
    rows += [("z", "0", "A", "t", [0.0, 0.0]), ("n", "0", "A", "t", None), ("z", "1", None, "t", [0.0, -0.0])]
    chunks = spark.createDataFrame(rows, SCHEMA)
    index = V.build_index(chunks, str(tmp_path / "i"), cells=4)
    asked = [("q0", [0.0, 0.0]), ("q1", [-1.0, -1.0]), ("q2", None), ("q3", [1.0, 0.0])]
    queries = spark.createDataFrame(asked, "query_id string, vec array<float>")
    assert hits(V.search_index(queries, index, 40, exact=True)) == hits(topk(queries, chunks, 40))
    assert int(index.sizes.sum()) == 32


@pytest.mark.parametrize("rows", [[], [("n", "0", None, "t", None)], [("z", "0", None, "t", [0.0, 0.0])]])
def test_tables_without_directions(spark, tmp_path, rows):
    chunks = spark.createDataFrame(rows, SCHEMA)
    index = V.build_index(chunks, str(tmp_path / "i"))
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<float>")
    assert V.search_index(queries, V.load_index(spark, index.path) if rows and rows[0][4] else index, 3).count() == (
        1 if rows and rows[0][4] else 0
    )


def test_search_and_answers_through_the_index(spark, chunks, index):
    queries = queries_of(chunks)
    plain = {tuple(r) for r in knowledge.search_kb(queries, chunks).select("query_id", "text").collect()}
    found = {tuple(r) for r in knowledge.search_kb(queries, chunks, index=index).select("query_id", "text").collect()}
    assert len(plain & found) >= 0.9 * len(plain)
    vec = chunks.filter("chunk_id = '3'").first()["vec"]
    messages = spark.createDataFrame([(1, 1, 1, "Track my order", None, None)], MESSAGES)
    messages = messages.withColumn("vec", F.array(*map(F.lit, vec)).cast("array<float>"))
    answered = triage.answer_messages(messages, chunks, max_held=2, index=index).first()
    assert answered["citations"][0] == "s3#3"


def test_a_question_is_sent_once_to_a_group_of_cells(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [("s", str(i), None, "t", draw.normal(size=8).tolist()) for i in range(2000)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    index = V.build_index(chunks, str(tmp_path / "i"), cells=40)
    queries = chunks.filter("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    written = {}

    def staged(df, name):
        written[name] = stage(df, name)
        return written[name]

    stage = V.stage
    monkeypatch.setattr(V, "stage", staged)
    found = V.search_index(queries, index, 3, exact=True, max_broadcast=10)
    assert hits(found) == hits(topk(queries, chunks, 3))
    # All cells make one group of 2,000 rows here: a question finds its k hits once, and goes on as one row.
    assert index.probes > 5
    assert written["chosen"].count() == written["asked"].count() == 500
    assert written["hits"].count() <= 500 * 3
    assert written["more"].count() <= 500


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_large_groups_see_the_cells_asked_for_alone(spark, chunks, index, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_BYTES", block)
    queries = queries_of(chunks)
    few = hits(V.search_index(queries, index, 4, probes=2))
    assert hits(V.search_index(queries, index, 4, probes=2, max_broadcast=5)) == few


@pytest.mark.parametrize("tile", [(16, 32), (256, 2048)])
def test_many_tiles_and_groups_give_the_best_of_all_pairs(monkeypatch, tile):
    monkeypatch.setattr(S, "TILE", tile)
    monkeypatch.setattr(V, "TILE", tile)
    draw = np.random.default_rng(8)
    values = draw.normal(size=(9000, 8)).astype(np.float32)
    cells = draw.integers(0, 30, 9000)

    def held(n):
        vec = pa.FixedSizeListArray.from_arrays(pa.array(values[:n].reshape(-1)), 8).cast(pa.list_(pa.float32()))
        ids = [f"{i:05}" for i in range(n)]
        return S._Vectors(pa.table({"source": ids, "chunk_id": ids, "carrier": pa.nulls(n, pa.string()), "vec": vec}))

    questions, rows = held(300), held(9000)
    scores = questions.unit() @ rows.unit().T
    wanted = np.argsort(-scores, axis=1)[:, :5]
    query, chunk, _ = S._best(questions, rows, 5)
    assert np.array_equal(chunk.reshape(300, 5), wanted)
    asks = draw.random((300, 30)) < 0.4
    asks[:, 0] = True
    wanted = np.argsort(np.where(asks[:, cells], -scores, np.inf), axis=1)[:, :5]
    nothing, near = np.full(300, np.nan), asks.argmax(axis=1)
    query, chunk, found = V._best_in_cells(questions, asks, nothing, near, rows, cells, 5)
    assert np.array_equal(chunk.reshape(300, 5), wanted)
    third = found.reshape(300, 5)[:, 2]
    query, chunk, _ = V._best_in_cells(questions, asks, third, near, rows, cells, 5)
    assert all(set(wanted[q, :3]) <= set(chunk[query == q]) <= set(wanted[q]) for q in range(300))
