"""Inverted-file index over a chunk table: rows lie in cells around centroids, a query reads the nearest cells.

The centroids are fitted on a bounded sample; every row lies in the cell of its nearest centroid.  The table is stored
by cell, so a search reads the files of the cells it asks for and nothing else, and work grows with the rows of
the probed cells.  Hits are ranked by exact cosine scores, as in ``topk``.

How many cells a query probes is measured when the index is built: as few as reach a wanted recall on sampled
queries.  An exact search goes on where that could miss something: each cell knows the widest angle between its
centroid and a row of it, so a cell that cannot hold a better hit than the worst one found is left out, and all
others are searched as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.vectors import normalize
from ..staging import stage, staging_dir
from .lookup import hot_keys, lookup_join
from .similarity import (
    BLOCK_BYTES, GROUPS_APART, HIT_COLUMNS, MAX_BROADCAST_BYTES, ROWS_OF_GROUP, TASKS_PER_CORE, TILE,
    _best_of, _best_of_tile, _by_query, _hit_table, _hits, _small, _TIE_ORDER, _Vectors, dealt, topk,
)

#: Centroids, whatever the size of the table; a row of theirs is a vector, so all of them can be sent to tasks.
MAX_CELLS = 4096
#: Rows that centroids are fitted on: so many for each, and no more than so many bytes of doubles.
SAMPLE_PER_CELL = 64
SAMPLE_BYTES = 256 << 20
#: Queries on which the number of probed cells is measured.
MEASURED = 200
LARGE_CARRIERS = 8
ROUNDS = 10
#: Row x cell scores that a task holds at a time.
SCORES_AT_ONCE = 1 << 19
#: Angles are compared with this slack, which is wider than the rounding of scores.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: chunk rows by cell, and what a query needs to choose cells."""

    path: str
    centroids: np.ndarray  # one unit row per cell, at most MAX_CELLS
    reach: np.ndarray  # widest angle between a cell's centroid and its rows
    sizes: np.ndarray  # rows of each cell
    probes: int

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    def carriers(self, spark: SparkSession) -> DataFrame:
        """(carrier, cells): the cells in which a carrier has chunks."""
        return spark.read.parquet(f"{self.path}/carriers")


def _share(df: DataFrame, wanted: int, total: int, *key: str) -> DataFrame:
    """About ``wanted`` of ``total`` rows, the same ones every time; all of them if there are no more."""
    if total <= wanted:
        return df
    parts = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(parts)) < int(wanted / total * parts))


def fit_centroids(chunks: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centroids by k-means under cosine, on at most ``SAMPLE_PER_CELL`` rows for each."""
    rows = chunks.filter("vec IS NOT NULL")
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    dim = len(rows.first()["vec"])
    cells = min(cells or math.ceil(math.sqrt(total)), MAX_CELLS, total)
    wanted = max(cells, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * dim)))
    unit = _share(rows, wanted, total, "source", "chunk_id").select(normalize(F.col("vec")).alias("unit"))
    # Zero vectors have no direction; they go to a cell like all others, but shape none.
    unit = unit.filter(F.exists("unit", lambda x: x != 0)).select(array_to_vector("unit").alias("features"))
    sample = stage(unit, "sample")
    found = sample.count()
    if not found:
        return np.zeros((1, dim))
    if found == 1 or cells == 1:
        centroids = np.array([sample.first()["features"].toArray()])
    else:
        means = KMeans(k=min(cells, found), maxIter=ROUNDS, seed=seed, distanceMeasure="cosine")
        centroids = np.array(means.fit(sample).clusterCenters())
    lengths = np.linalg.norm(centroids, axis=1, keepdims=True)
    return centroids / np.where(lengths > 0, lengths, 1.0)


def _slices(batches: Iterable[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that their scores for all cells stay small, however many cells there are."""
    rows = max(1, SCORES_AT_ONCE // max(1, cells))
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, len(batch), rows))


def _assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows with the ``cell`` of their nearest centroid and their ``angle`` to it."""
    schema = StructType([*chunks.schema.fields, *StructType.fromDDL("cell int, angle double").fields])
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(centroids)):
            table = pa.Table.from_batches([batch]).append_column("carrier_", pa.nulls(len(batch), pa.string()))
            unit = _Vectors(table.select(["vec", "carrier_"]).rename_columns(["vec", "carrier"])).unit()
            near = unit @ shared.value.T if len(unit) else np.zeros((0, 1))
            cell = near.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"]
            )

    return chunks.mapInArrow(assign, schema)


def build_index(
    chunks: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 5
) -> VectorIndex:
    """Write an index of all rows with a vector to the folder ``path``, which must be new.

    ``chunks`` has source, chunk_id, vec and may have carrier, text and more.  ``probes`` becomes the smallest
    number of cells that reaches ``recall`` of the ``k`` best hits on a sample of the rows as queries.
    """
    spark = chunks.sparkSession
    rows = chunks.filter("vec IS NOT NULL")
    if "carrier" not in rows.columns:
        rows = rows.withColumn("carrier", F.lit(None).cast("string"))
    centroids = fit_centroids(rows, cells)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if len(centroids):
        rows = _assigned(rows, centroids)
    else:
        rows = rows.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)})
    # By cell and row, so that a crowded cell is written by several tasks.
    dealt = rows.repartitionByRange(tasks, "cell", F.xxhash64("source", "chunk_id"))
    if len(centroids):
        dealt.write.partitionBy("cell").parquet(f"{path}/cells")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/cells") if len(centroids) else rows
    known = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()
    sizes, reach = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for row in known:  # one per cell
        sizes[row["cell"]], reach[row["cell"]] = row["n"], row["reach"]
    per_carrier = stored.filter("carrier IS NOT NULL").groupBy("carrier").agg(F.collect_set("cell").alias("cells"))
    per_carrier.write.parquet(f"{path}/carriers")
    index = VectorIndex(path, centroids, reach, sizes, max(1, len(centroids)))
    index = VectorIndex(path, centroids, reach, sizes, _measured_probes(spark, index, recall, k))
    spark.createDataFrame(
        [(c, v.tolist(), float(r), int(n), index.probes) for c, (v, r, n) in enumerate(zip(centroids, reach, sizes))],
        "cell int, centroid array<double>, reach double, n bigint, probes int",
    ).write.parquet(f"{path}/centroids")
    return index


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # one per cell
    centroids = np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0))
    return VectorIndex(
        path, centroids, np.array([r["reach"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.int64),
        rows[0]["probes"] if rows else 1,
    )


def _measured_probes(spark: SparkSession, index: VectorIndex, recall: float, k: int) -> int:
    """The smallest number of nearest cells that hold ``recall`` of the true hits of sampled rows.

    Rows ask among all rows, within their carrier and within another large one; the kind that needs most cells decides.
    """
    total = int(index.sizes.sum())
    if not total:
        return 1
    stored = index.chunks(spark)
    own = F.concat_ws("\x01", "source", "chunk_id")
    asked = _share(stored, MEASURED, total, "chunk_id", "source").select(own.alias("own"), "vec", "carrier")
    large = index.carriers(spark).orderBy(F.size("cells").desc(), "carrier").limit(LARGE_CARRIERS).collect()
    large = F.array(*[F.lit(r["carrier"]) for r in large]).cast("array<string>")
    kinds = F.create_map(
        F.lit("all"), F.lit(None).cast("string"), F.lit("own"), F.col("carrier"),
        F.lit("other"), F.get(large, F.pmod(F.xxhash64("own"), F.greatest(F.size(large), F.lit(1))).cast("int")),
    )
    asked = asked.dropDuplicates(["own"]).select("own", "vec", F.explode(kinds).alias("kind", "carrier"))
    asked = asked.filter("kind = 'all' OR carrier IS NOT NULL")
    asked = stage(asked.select("*", F.concat_ws("\x01", "kind", "own").alias("query_id")), "measured")
    hits = topk(asked.select("query_id", "carrier", "vec"), stored.select("source", "chunk_id", "carrier", "vec"), k + 1)
    chosen = _with_cells(asked.join(_opened(spark, index), "carrier", "left"), index)
    # MEASURED * k hits of each kind.  A row finds itself in its own cell, which says nothing about other queries.
    others = F.broadcast(hits.select("query_id", "source", "chunk_id"))
    met = stored.select("source", "chunk_id", "cell").join(others, ["source", "chunk_id"])
    met = met.join(F.broadcast(chosen), "query_id").filter(own != F.col("own"))
    needed = met.groupBy("kind").agg(F.collect_list(F.array_position("cells", F.col("cell"))).alias("n")).collect()
    worst = [sorted(r["n"])[math.ceil(recall * len(r["n"])) - 1] for r in needed]
    return max([1, *worst])


def _opened(spark: SparkSession, index: VectorIndex) -> DataFrame:
    return index.carriers(spark).withColumnRenamed("cells", "open")


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float64)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _nearness(batch: pa.RecordBatch, index: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of questions and centroids, and whether a cell is open to a question."""
    centroids, _, filled = index
    near = np.clip(_unit(np.array(batch.column("vec").to_pylist())) @ centroids.T, -1.0, 1.0)
    opened = np.broadcast_to(filled, near.shape).copy()
    lists = batch.column("open")
    for q in np.flatnonzero(np.asarray(lists.is_valid())):
        held = np.zeros(len(filled), bool)
        held[lists[q].values.to_numpy(zero_copy_only=False)] = True
        opened[q] = held
    return near, opened


def _in_turn(near: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """All cells of each question, nearest first and those that are not open last."""
    return np.argsort(np.where(opened, -near, np.inf), axis=1, kind="stable")


def _told(index: VectorIndex) -> tuple[np.ndarray, ...]:
    return index.centroids, index.reach, index.sizes > 0


def _with_cells(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """Queries with all ``cells`` open to them, nearest first."""
    schema = StructType([*queries.drop("open").schema.fields, *StructType.fromDDL("cells array<int>").fields])
    shared = queries.sparkSession.sparkContext.broadcast(_told(index))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(shared.value[0])):
            near, opened = _nearness(batch, shared.value)
            order, many = _in_turn(near, opened), opened.sum(axis=1)
            cells = pa.array([o[:n] for o, n in zip(order, many)], pa.list_(pa.int32()))
            kept = [batch.column(c) for c in batch.schema.names if c != "open"]
            yield pa.RecordBatch.from_arrays([*kept, cells], names=schema.names)

    return queries.mapInArrow(choose, schema)


#: A question as it is sent: its nearest cell, how many cells it asks for, which ones and which others are open to it
#: as bits, and the score below which it wants no hit.
ASKED = "near int, n int, cells binary, others binary, worst double"


def _bits(chosen: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.packbits(chosen, axis=1)], pa.binary())


def _chosen(bits: pa.Array | pa.ChunkedArray, cells: int) -> np.ndarray:
    """Which of so many cells each question asks for."""
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -(-cells // 8))
    return np.unpackbits(packed, axis=1, count=cells).astype(bool)


def _asking(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """Queries (query_id, carrier, vec, open) with what ``ASKED`` says of their nearest ``probes`` cells."""
    kept = ["query_id", "carrier", "vec"]
    schema = StructType([*queries.select(*kept).schema.fields, *StructType.fromDDL(ASKED).fields])
    shared = queries.sparkSession.sparkContext.broadcast(_told(index))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(shared.value[0])):
            near, opened = _nearness(batch, shared.value)
            order = _in_turn(near, opened)
            first = np.zeros(near.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            first &= opened
            told = [
                pa.array(order[:, 0].astype(np.int32)), pa.array(first.sum(axis=1).astype(np.int32)),
                _bits(first), _bits(opened & ~first), pa.nulls(len(batch), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *told], names=schema.names)

    return queries.mapInArrow(ask, schema)


def _going_on(asked: DataFrame, index: VectorIndex) -> DataFrame:
    """``asked`` with the other cells that may hold a hit as good as ``worst``, or all if that is null."""
    shared = asked.sparkSession.sparkContext.broadcast(_told(index))
    names = asked.columns

    def go_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, reach, _ = shared.value
        for batch in _slices(batches, len(centroids)):
            near = np.clip(_unit(np.array(batch.column("vec").to_pylist())) @ centroids.T, -1.0, 1.0)
            bound = np.cos(np.clip(np.arccos(near) - reach - SLACK, 0.0, np.pi))
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            more = _chosen(batch.column("others"), len(centroids)) & ~(bound < worst[:, None])
            columns = dict(zip(names, batch.columns))
            columns |= {"n": pa.array(more.sum(axis=1).astype(np.int32)), "cells": _bits(more)}
            told = pa.RecordBatch.from_arrays([columns[c] for c in names], schema=batch.schema)
            yield told.filter(pa.array(more.any(axis=1)))

    return asked.mapInArrow(go_on, asked.schema)


def _by_cell(asked: DataFrame, cells: int) -> DataFrame:
    """(query_id, carrier, vec, cell): a row for each cell that a question asks for."""
    kept = ["query_id", "carrier", "vec"]
    schema = StructType([*asked.select(*kept).schema.fields, *StructType.fromDDL("cell int").fields])

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cell = np.nonzero(_chosen(batch.column("cells"), cells))
            asking = batch.select(kept).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*asking.columns, pa.array(cell.astype(np.int32))], names=schema.names)

    return asked.select(*kept, "cells").mapInArrow(visit, schema)


def _found(asked: DataFrame, index: VectorIndex, k: int, max_broadcast: int | None) -> DataFrame:
    """Hits of ``asked``, whose k best for each question are its hits in the cells that it asks for."""
    width = 8 if "double" in dict(asked.dtypes)["vec"] else 4
    visits, size = asked.agg(F.sum("n"), F.sum(width * F.size("vec") * F.col("n").cast("bigint"))).first()
    if (size or 0) <= MAX_BROADCAST_BYTES and (max_broadcast is None or (visits or 0) <= max_broadcast):
        return _visits(_by_cell(asked, len(index.centroids)), index, k, max_broadcast)
    return _meet_in_groups(asked, index, k)


def _visits(asked: DataFrame, index: VectorIndex, k: int, max_broadcast: int | None) -> DataFrame | None:
    """The k best hits that each task finds for ``asked`` (query_id, carrier, vec, cell) in the cells asked for.

    They go to the tasks that read the cells, and no chunk moves; None if they are too many to be held.
    """
    spark = asked.sparkSession
    chunks = index.chunks(spark).select("source", "chunk_id", "carrier", "vec", "cell")
    types = {**dict(asked.dtypes), **dict(chunks.dtypes), "rank": "int", "score": "double"}
    ddl = ", ".join(f"{c} {types[c]}" for c in HIT_COLUMNS)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # one per cell
    chunks = chunks.filter(F.col("cell").isin(sorted(counts))) if len(counts) < len(index.centroids) else chunks
    held = _small(asked.select("query_id", "carrier", "vec", "cell"), max_broadcast)
    if held is None:
        return None
    shared = spark.sparkContext.broadcast(held)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: dict[int, _Vectors] = {}
        best: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for cell in np.unique(table["cell"].to_numpy()):
                if cell not in asking:
                    mask = pa.array(shared.value["cell"].to_numpy() == cell)
                    asking[cell] = _Vectors(shared.value.filter(mask))
                mask = pa.array(table["cell"].to_numpy() == cell)
                hits = _hits(asking[cell], _Vectors(table.filter(mask), _TIE_ORDER), k, schema)
                best[cell] = _best_of(pa.concat_tables([best[cell], hits]), k) if cell in best else hits
        for hits in best.values():
            yield from hits.to_batches()

    return chunks.mapInArrow(scan, ddl)


def _groups(sizes: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: neighbours with a block of rows in all, or one cell with more; -1 for empty cells."""
    groups, group, held = np.full(len(sizes), -1, np.int32), -1, block + 1
    for cell in np.flatnonzero(sizes):
        if held + sizes[cell] > block:
            group, held = group + 1, 0
        groups[cell] = group
        held += sizes[cell]
    return groups


def _best_in_cells(
    questions: _Vectors, asks: np.ndarray, worst: np.ndarray, near: np.ndarray, rows: _Vectors, place: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` where a question sees the rows of the cells it ``asks`` for; ``place`` is the cell of each row."""
    found = []
    for carrier, asking in questions.by_carrier.items():
        part, single = rows.part(carrier)
        cell = place[part]
        order = np.argsort(cell, kind="stable")
        ends = np.cumsum(np.bincount(cell, minlength=asks.shape[1]))
        of_cell = np.split(order, ends[:-1])
        # Questions of one place in space share their cells.
        asking = asking[np.argsort(near[asking], kind="stable")]
        for at in range(0, len(asking), TILE[0]):
            some = asking[at:at + TILE[0]]
            mine = asks[some]
            wanted = mine.sum(axis=0)
            visited = np.flatnonzero(wanted)
            if not len(visited):
                continue
            visited = visited[np.argsort(-wanted[visited], kind="stable")]
            seen = None if mine[:, visited].all() else lambda rows, mine=mine: mine[:, cell[rows]]
            rows_in_turn = np.concatenate([of_cell[c] for c in visited])
            if len(rows_in_turn):
                found.append(
                    _best_of_tile(questions, some, rows, part, single, k, rows_in_turn, seen, worst[some])
                )
    return _by_query(found)


def _meet_in_groups(asked: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """The k best hits of ``asked`` in each group of cells.

    A question is sent once to a group of cells that it asks for, whatever their number.  Blocks of questions and of
    the rows of a group meet, and a group never holds more than the two.
    """
    spark = asked.sparkSession
    chunks = index.chunks(spark).select("source", "chunk_id", "carrier", "vec", "cell")
    types = {**dict(asked.dtypes), **dict(chunks.dtypes), "rank": "int", "score": "double"}
    ddl = ", ".join(f"{c} {types[c]}" for c in HIT_COLUMNS)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    block = max(1024, BLOCK_BYTES // (8 * index.centroids.shape[1]))
    groups = _groups(index.sizes, block)
    members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
    n_cells = len(groups)
    shared = spark.sparkContext.broadcast(members)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = _chosen(batch.column("cells"), n_cells)
            n = [int(asks[:, cells].any(axis=1).sum()) for cells in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], ["group", "n"])

    counts = asked.select("cells").mapInArrow(counted, "group int, n bigint").groupBy("group").sum("n").collect()
    counts = {g: n for g, n in counts if n}  # one per group
    if len(counts) < len(members):
        chunks = chunks.filter(F.col("cell").isin([int(c) for g in counts for c in members[g]]))
    row_blocks = {g: -(-int(index.sizes[members[g]].sum()) // block) for g in counts}
    # Smaller blocks of questions where there would be fewer meetings than tasks wanted.
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    wanted = -(-tasks // max(1, sum(row_blocks.values())))
    query_blocks = {g: max(-(-n // block), min(wanted, -(-n // ROWS_OF_GROUP))) for g, n in counts.items()}
    parts = spark.createDataFrame(
        [(int(c), g, row_blocks[g], query_blocks[g]) for g in counts for c in members[g]],
        "cell int, group int, row_blocks int, query_blocks int",
    )
    apart = GROUPS_APART * max(1, sum(row_blocks[g] * query_blocks[g] for g in counts))

    kept = ["query_id", "carrier", "vec", "near", "worst"]
    sent_schema = StructType(
        [*asked.select(*kept).schema.fields, *StructType.fromDDL("cells binary, group int").fields]
    )

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = _chosen(batch.column("cells"), n_cells)
            for group, cells in enumerate(shared.value):
                rows = np.flatnonzero(asks[:, cells].any(axis=1))
                asking = batch.select(kept).take(pa.array(rows))
                told = [_bits(asks[np.ix_(rows, cells)]), pa.array(np.full(len(rows), group, np.int32))]
                yield pa.RecordBatch.from_arrays([*asking.columns, *told], names=sent_schema.names)

    def blocks(df: DataFrame, own: str, other: str, *key: str) -> DataFrame:
        hashed = F.pmod(F.xxhash64(*key), F.col(f"{own}_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return df.withColumn(f"{own}_block", hashed).withColumn(f"{other}_block", every)

    keys = ["group", "query_block", "row_block"]
    sent = asked.select(*kept, "cells").mapInArrow(send, sent_schema)
    by_group = parts.select("group", "row_blocks", "query_blocks").distinct()
    left = blocks(sent.join(F.broadcast(by_group), "group"), "query", "row", "query_id")  # one row per group
    right = blocks(chunks.join(F.broadcast(parts), "cell"), "row", "query", "source", "chunk_id")  # one row per cell
    left = left.select(*kept, "cells", *keys).repartition(apart, *keys)
    right = right.select("source", "chunk_id", "carrier", "vec", "cell", *keys).repartition(apart, *keys)

    def meet(questions: pa.Table, rows: pa.Table) -> pa.Table:
        asking, against = _Vectors(questions), _Vectors(rows, _TIE_ORDER)
        if not (len(asking) and len(against)):
            return schema.empty_table()
        cells = shared.value[questions["group"][0].as_py()]
        found = _best_in_cells(
            asking, _chosen(questions["cells"], len(cells)), questions["worst"].to_numpy().astype(float),
            questions["near"].to_numpy(), against, np.searchsorted(cells, against.table["cell"].to_numpy()), k,
        )
        return _hit_table(asking, against, *found, schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ddl)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*HIT_COLUMNS)


def search_index(
    queries: DataFrame,
    index: VectorIndex,
    k: int,
    *,
    probes: int | None = None,
    exact: bool = False,
    max_broadcast: int | None = None,
) -> DataFrame:
    """(query_id, rank, source, chunk_id, score): as ``topk``, from the ``probes`` nearest cells of each query.

    ``queries`` has query_id (unique), vec and may have carrier; a query with a carrier reads the nearest cells
    that hold rows of it, or all kinds of rows if there are none.  With ``exact``, cells that may hold a better hit
    are searched in a second pass, and the hits are those of ``topk``.
    """
    spark = queries.sparkSession
    carrier = F.col("carrier").cast("string") if "carrier" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", carrier.alias("carrier"), "vec").filter("vec IS NOT NULL")
    if not len(index.centroids):
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(HIT_COLUMNS[1:], ("int", "string", "string", "double"))]
        return asked.filter("false").select("query_id", *nothing)
    asked = stage(asked, "asked")
    known = lookup_join(asked, _opened(spark, index), "carrier", "left", hot_keys(asked, "carrier"))
    known = known.withColumn("carrier", F.when(F.col("open").isNotNull(), F.col("carrier")))
    chosen = stage(_asking(dealt(known), index, probes or index.probes), "chosen")
    first = stage(_found(chosen, index, k, max_broadcast), "hits")
    if not exact:
        return _ranked(first, k)
    best = _ranked(first, k)
    worst = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    going_on = chosen.drop("worst").join(worst, "query_id", "left").select(*chosen.columns)
    more = stage(_going_on(going_on, index), "more")
    return _ranked(first.unionByName(_found(more, index, k, max_broadcast)), k)


def index_for(chunks: DataFrame, name: str, **options) -> VectorIndex:
    """An index of a job of its own, in the shared folder."""
    import uuid

    return build_index(chunks, f"{staging_dir(chunks.sparkSession)}/{name}-{uuid.uuid4().hex}", **options)
