"""Exact top-k cosine retrieval of many queries against many chunks.

The pairs are never rows: each task multiplies a block of query vectors with a block of chunk
vectors and emits at most k hits per query.  A side that fits into memory is sent to the tasks
that scan the other one; if neither is, both are cut into bounded blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..staging import stage
from .lookup import hot_keys, lookup_join

MAX_BROADCAST_BYTES = 256 << 20  # of vectors and texts, as they are stored
BLOCK_BYTES = 64 << 20  # of one block of vectors as doubles
TILE = (256, 2048)  # query x chunk scores held by a task; few enough for a cache of a core
FIRST_FLOOR = 512  # columns of the first tile whose k-th best score is the first floor
RESCORED = 1 << 14  # pairs that are scored in doubles at once
ROWS_AT_ONCE = 1 << 14  # rows brought to unit length at once
ROWS_OF_GROUP = 4096  # queries that a group has at least, where there are so many
GROUPS_APART = 4  # partitions for each group of blocks that meet
TASKS_PER_CORE = 4  # of a scan, so that slow tasks even out
# Scores are compared to nine digits: vectors are 32-bit, so anything finer is noise.
SCORE_DIGITS = 9

HIT_COLUMNS = ["query_id", "rank", "source", "chunk_id", "score"]


class _Vectors:
    """Vectors of one block with their carriers, in the row order it was built with."""

    def __init__(self, table: pa.Table, sort_by: list[tuple[str, str]] | None = None):
        if sort_by:
            table = table.sort_by(sort_by)
        self.table = table
        flat = table["vec"].combine_chunks()
        dim = len(flat[0]) if len(flat) else 0
        self.values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)
        self.parts: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.values)

    @cached_property
    def lengths(self) -> np.ndarray:
        found = np.empty((len(self), 1))
        for at in range(0, len(self), ROWS_AT_ONCE):
            rows = slice(at, at + ROWS_AT_ONCE)
            found[rows] = np.linalg.norm(np.asarray(self.values[rows], dtype=np.float64), axis=1, keepdims=True)
        return np.where(found > 0, found, 1.0)

    def unit(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Rows at unit length, as doubles."""
        return np.asarray(self.values[rows], dtype=np.float64) / self.lengths[rows]

    @cached_property
    def by_carrier(self) -> dict[str | None, np.ndarray]:
        """Rows of each carrier, in row order."""
        codes = self.table["carrier"].combine_chunks().dictionary_encode()
        found = np.asarray(codes.indices.fill_null(-1)) if len(self) else np.empty(0, np.int32)
        order = np.argsort(found, kind="stable")
        starts = np.flatnonzero(np.diff(found[order], prepend=-2))
        names = codes.dictionary.to_pylist()
        return {
            None if found[rows[0]] < 0 else names[found[rows[0]]]: rows
            for rows in np.split(order, starts[1:]) if len(rows)
        }

    def part(self, carrier: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows that a query with this carrier sees, and their unit vectors as floats."""
        if carrier not in self.parts:
            rows = np.arange(len(self)) if carrier is None else self.by_carrier.get(carrier, np.empty(0, np.int64))
            self.parts[carrier] = rows, self.single(rows)
        return self.parts[carrier]

    def single(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.values.shape[1]), dtype=np.float32)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            out[at:at + ROWS_AT_ONCE] = self.unit(rows[at:at + ROWS_AT_ONCE])
        return out


def _at_least(scores: np.ndarray, floor: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the scores that reach the floor of their row, which are few; ``mask`` is room to work in."""
    height, width = scores.shape
    if width < mask.shape[1]:
        mask = np.zeros((height, -(-width // 8) * 8), dtype=bool)
    np.greater_equal(scores, floor[:, None], out=mask[:, :width])
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64))  # eight at a time
    word, place = np.nonzero(mask.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + place, mask.shape[1])


def _best(queries: _Vectors, chunks: _Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, chunk rows, scores) of the k best chunks of each query, best first; chunk rows are in tie order.

    Scores in floats, whose error is bounded, leave few pairs of a tile that can be among the k best; those are
    scored in doubles.
    """
    found = []
    if len(chunks) and len(queries):
        for carrier, asking in queries.by_carrier.items():
            rows, single = chunks.part(carrier)
            for at in range(0, len(asking), TILE[0]):
                if len(rows):
                    found.append(_best_of_tile(queries, asking[at:at + TILE[0]], chunks, rows, single, k))
    return _by_query(found)


def _by_query(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    query, chunk, score = (np.concatenate(parts) for parts in zip(nothing, *found))
    order = np.argsort(query, kind="stable")
    return query[order], chunk[order], score[order]


def _best_of_tile(
    queries: _Vectors, asking: np.ndarray, chunks: _Vectors, rows: np.ndarray, single: np.ndarray, k: int,
    order: np.ndarray | None = None, seen: Callable[[np.ndarray], np.ndarray] | None = None,
    worst: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of the queries ``asking`` among the chunks ``rows``, tile by tile.

    What reaches the floor is scored in doubles after 1, 2, 4 ... tiles, so that each query has some k rows to score
    at a time, however many tiles there are.  With ``order`` only those places of ``rows`` count, in that order,
    with ``seen`` each query has its own part of them, and what is below its ``worst`` is left out.
    """
    # Of a sum of products of unit vectors: a rounding of either side and of each step.
    error = (single.shape[1] + 8) * float(np.finfo(np.float32).eps) + 10.0 ** -SCORE_DIGITS
    unit = queries.unit(asking)
    left = unit.astype(np.float32)
    query, chunk, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    floor = np.full(len(asking), -np.inf, dtype=np.float32)
    if worst is not None:
        floor = (np.nan_to_num(worst, nan=-np.inf) - 2 * error).astype(np.float32)
    scores, mask = np.empty((len(asking), TILE[1]), np.float32), np.empty((len(asking), TILE[1]), bool)
    tiles = -(-(len(rows) if order is None else len(order)) // TILE[1])
    reached, waiting, due = [], 0, 1
    for number in range(1, tiles + 1):
        at = (number - 1) * TILE[1]
        place = None if order is None else order[at:at + TILE[1]]
        right = (single[at:at + TILE[1]] if place is None else single[place]).T
        near = np.matmul(left, right, out=scores) if right.shape[1] == TILE[1] else left @ right
        if seen is not None:
            np.copyto(near, np.nan, where=~seen(place))  # reaches no floor
        if at == 0 and k < near.shape[1]:
            some = np.nan_to_num(near[:, :max(k + 1, FIRST_FLOOR)], nan=-np.inf)
            kth = (np.partition(some, -k, axis=1)[:, -k] - 2 * error).astype(np.float32)
            floor = np.maximum(floor, kth)
        q, c = _at_least(near, floor, mask)
        reached.append((q, rows[at + c if place is None else place[c]]))
        waiting += len(q)
        if not waiting or (number < due and number < tiles and waiting < RESCORED):
            continue
        q, c = (np.concatenate(parts) for parts in zip(*reached))
        reached, waiting, due = [], 0, 2 * number
        for start in range(0, len(q), RESCORED):
            some = slice(start, start + RESCORED)
            exact = np.einsum("ij,ij->i", unit[q[some]], chunks.unit(c[some]))
            query, chunk = np.concatenate([query, q[some]]), np.concatenate([chunk, c[some]])
            score = np.concatenate([score, np.round(exact, SCORE_DIGITS)])
            best = np.lexsort((chunk, -score, query))
            best = best[_places(query[best]) < k]
            query, chunk, score = query[best], chunk[best], score[best]
        last = np.flatnonzero(_places(query) == k - 1)
        floor[query[last]] = np.maximum(floor[query[last]], (score[last] - error).astype(np.float32))
    return asking[query], chunk, score


def _places(keys: np.ndarray) -> np.ndarray:
    """The number of each row among those with its key; equal keys stand together."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _hits(queries: _Vectors, chunks: _Vectors, k: int, schema: pa.Schema) -> pa.Table:
    return _hit_table(queries, chunks, *_best(queries, chunks, k), schema)


def _hit_table(
    queries: _Vectors, chunks: _Vectors, query_rows: np.ndarray, chunk_rows: np.ndarray, scores: np.ndarray,
    schema: pa.Schema,
) -> pa.Table:
    return pa.table(
        [
            queries.table["query_id"].take(pa.array(query_rows)),
            pa.array((_places(query_rows) + 1).astype(np.int32)),
            chunks.table["source"].take(pa.array(chunk_rows)),
            chunks.table["chunk_id"].take(pa.array(chunk_rows)),
            pa.array(scores),
        ],
        names=HIT_COLUMNS,
    ).cast(schema)


_TIE_ORDER = [("source", "ascending"), ("chunk_id", "ascending")]


def _small(df: DataFrame, cap: int | None = None) -> pa.Table | None:
    """The rows if they are not too large (and, where ``cap`` is given, not more than that), else None."""
    if cap is not None and not df.offset(cap).isEmpty():
        return None
    text = F.octet_length("text") if "text" in df.columns else F.lit(0)
    width = 8 if "double" in dict(df.dtypes)["vec"] else 4
    size = df.agg(F.sum(width * F.size("vec") + F.coalesce(text, F.lit(0)))).first()[0] or 0
    return df.toArrow() if size <= MAX_BROADCAST_BYTES else None


def _best_of(hits: pa.Table, k: int) -> pa.Table:
    """The k best hits of each query."""
    ordered = hits.sort_by(
        [("query_id", "ascending"), ("score", "descending"), *_TIE_ORDER]
    )
    query = ordered["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    return ordered.filter(pa.array(_places(query) < k))


def dealt(df: DataFrame) -> DataFrame:
    """Rows that each cost much, over more tasks than there are cores, whatever the file they come from."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def _block(df: DataFrame, name: str, blocks: int, *key: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"))


def _every(df: DataFrame, name: str, blocks: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _or_all(queries: DataFrame, present: Column) -> DataFrame:
    """Clear the carrier of queries that no chunk matches, so that they search everything."""
    return queries.withColumn("carrier", F.when(present, F.col("carrier")))


def _carriers(chunks: pa.Table) -> list[str]:
    return sorted({c for c in chunks["carrier"].to_pylist() if c is not None})


def topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    max_broadcast: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """(query_id, rank, source, chunk_id, score): the k best chunks of each query.

    ``queries`` has query_id (unique) and vec, ``chunks`` has source, chunk_id and vec; both may have a
    carrier.  A query with a carrier sees that carrier's chunks, or all if there are none.  Ties go
    to the smaller (source, chunk_id).
    """
    no_carrier = F.lit(None).cast("string")
    limited = "carrier" in queries.columns and "carrier" in chunks.columns
    carrier = F.col("carrier").cast("string") if limited else no_carrier
    queries = queries.select("query_id", carrier.alias("carrier"), "vec").filter("vec IS NOT NULL")
    chunks = chunks.select("source", "chunk_id", carrier.alias("carrier"), "vec").filter("vec IS NOT NULL")

    spark = chunks.sparkSession
    types = {**dict(queries.dtypes), **dict(chunks.dtypes), "rank": "int", "score": "double"}
    ddl = ", ".join(f"{c} {types[c]}" for c in HIT_COLUMNS)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    held = _small(chunks, max_broadcast)
    if held is not None:
        queries = _or_all(queries, F.col("carrier").isin(_carriers(held)))
        shared = spark.sparkContext.broadcast(held.sort_by(_TIE_ORDER))

        def scan_queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            against = _Vectors(shared.value)
            for batch in batches:
                hits = _hits(_Vectors(pa.Table.from_batches([batch])), against, k, schema)
                yield from hits.to_batches()

        # Each query saw all chunks, so its hits are final as they are.
        return dealt(queries).mapInArrow(scan_queries, ddl)

    if limited:
        present = chunks.filter("carrier IS NOT NULL").select("carrier").distinct()
        known = present.withColumn("known", F.lit(True))
        looked_up = lookup_join(queries, known, "carrier", "left", hot_keys(queries, "carrier"))
        queries = _or_all(looked_up, F.col("known")).drop("known")
    found = _scan_chunks(queries, dealt(chunks), k, ddl, schema, max_broadcast)
    if found is None:
        found = _meet_in_blocks(queries, chunks, k, ddl, schema, block)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(*HIT_COLUMNS)


def _scan_chunks(
    queries: DataFrame, chunks: DataFrame, k: int, ddl: str, schema: pa.Schema, max_broadcast: int | None
) -> DataFrame | None:
    """The k best hits per query and task of the chunks, if the queries are few enough to hold."""
    held = _small(queries, max_broadcast)
    if held is None:
        return None
    shared = queries.sparkSession.sparkContext.broadcast(held)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = _Vectors(shared.value)
        best = None
        for batch in batches:
            against = _Vectors(pa.Table.from_batches([batch]), _TIE_ORDER)
            hits = _hits(asking, against, k, schema)
            best = hits if best is None else _best_of(pa.concat_tables([best, hits]), k)
        if best is not None:
            yield from best.to_batches()

    return chunks.mapInArrow(scan, ddl)


def _meet_in_blocks(
    queries: DataFrame, chunks: DataFrame, k: int, ddl: str, schema: pa.Schema, block: int | None
) -> DataFrame:
    """The k best hits of each query in a group: a block of queries, which is held, and chunks, which come by in portions.

    A group has all chunks, so that a query is sent once, or a part of them where that sends fewer rows.  It holds two
    ``block`` of queries, ``block`` chunks and the hits so far, whatever the sizes of the two sides.
    """
    if block is None:
        block = max(1024, BLOCK_BYTES // (8 * len(queries.first()["vec"])))
    n_queries, n_chunks = queries.count(), chunks.count()
    # More groups than blocks that can be held where there would be fewer than tasks wanted, so that all cores have some.
    tasks = TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    wanted, least = min(tasks, -(-n_queries // ROWS_OF_GROUP)), max(1, -(-n_queries // (2 * block)))
    parts = max(1, min(-(-wanted // least), -(-n_chunks // ROWS_OF_GROUP)))
    blocks, parts = min((max(least, wanted), 1), (least, parts), key=lambda x: n_chunks * x[0] + n_queries * x[1])
    # Groups are few and costly: with some times as many partitions, hardly any two of them share one.
    apart = GROUPS_APART * blocks * parts
    of_rows = schema.set(0, pa.field("query_id", pa.int64()))  # ids may repeat, rows do not

    def met(asking: _Vectors, arrived: list[pa.Table], best: pa.Table | None) -> pa.Table:
        hits = _hits(asking, _Vectors(pa.concat_tables(arrived), _TIE_ORDER), k, of_rows)
        return hits if best is None else _best_of(pa.concat_tables([best, hits]), k)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, arrived, best, asking, current = [], [], None, None, None
        for table in _by_block(batches):
            number = table["group"][0].as_py()
            if number != current:
                yield from told(asked, asking, arrived, best)
                asked, arrived, best, asking, current = [], [], None, None, number
            is_query = table["is_query"]
            asked.append(table.filter(is_query).select(["query_id", "carrier", "asked"]))
            arrived.append(table.filter(pc.invert(is_query)).select(["source", "chunk_id", "carrier", "vec"]))
            if sum(map(len, arrived)) >= block:
                asking = asking or rows_of(asked)
                best, arrived = met(asking, arrived, best), []
        yield from told(asked, asking, arrived, best)

    def rows_of(asked: list[pa.Table]) -> _Vectors:
        table = pa.concat_tables(asked)
        number = pa.array(np.arange(len(table)))
        return _Vectors(pa.table([number, table["carrier"], table["asked"]], ["query_id", "carrier", "vec"]))

    def told(
        asked: list[pa.Table], asking: _Vectors | None, arrived: list[pa.Table], best: pa.Table | None
    ) -> Iterator[pa.RecordBatch]:
        if sum(map(len, asked)) and sum(map(len, arrived)):
            best = met(asking or rows_of(asked), arrived, best)
        if best is not None:
            ids = pa.concat_tables(asked)["query_id"].take(best["query_id"])
            yield from best.set_column(0, "query_id", ids).cast(schema).to_batches()

    none = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c]).alias(c)
    group = (F.col("qb") * parts + F.col("cb")).alias("group")
    left = _every(_block(queries, "qb", blocks, "query_id"), "cb", parts).select(
        group, F.lit(True).alias("is_query"), "query_id", "carrier", F.col("vec").alias("asked"),
        *(none(chunks, c) for c in ("source", "chunk_id", "vec")),
    )
    right = _every(_block(chunks, "cb", parts, "source", "chunk_id"), "qb", blocks).select(
        group, F.lit(False).alias("is_query"), none(queries, "query_id"), "carrier", none(queries, "vec").alias("asked"),
        "source", "chunk_id", "vec",
    )
    dealt_out = left.unionByName(right).repartition(apart, "group")
    return dealt_out.sortWithinPartitions("group", F.col("is_query").desc()).mapInArrow(meet, ddl)


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces of batches with one ``group`` each, in order."""
    for batch in batches:
        number = batch.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield pa.Table.from_batches([batch.slice(start, end - start)])


HIT_LIST = "array<struct<rank:int,text:string,score:double,source:string,chunk_id:string>>"


def small_chunk_hits(
    chunks: DataFrame, k: int, max_broadcast: int | None = None
) -> Callable[[Column, Column], Column] | None:
    """Function (vec, carrier) -> hit list that holds the whole chunk table, if that is small.

    No shuffle and no join: the hits appear in the row that asks.  A null vector gets no hits.
    """
    columns = ["source", "chunk_id", "carrier", "vec", "text"]
    held = _small(chunks.select(*columns).filter("vec IS NOT NULL"), max_broadcast)
    if held is None:
        return None
    shared = chunks.sparkSession.sparkContext.broadcast(held.sort_by(_TIE_ORDER))
    carriers = set(_carriers(held))
    prepared: list[_Vectors] = []  # one per Python worker

    @F.arrow_udf(HIT_LIST)
    def find(vec: pa.Array, carrier: pa.Array) -> pa.Array:
        if not prepared:
            prepared.append(_Vectors(shared.value))
        against = prepared[0]
        asked = np.flatnonzero(np.asarray(vec.is_valid()))
        wanted = [c if c in carriers else None for c in carrier.take(pa.array(asked)).to_pylist()]
        asking = _Vectors(
            pa.table({"vec": vec.take(pa.array(asked)), "carrier": pa.array(wanted, pa.string())})
        )
        query_rows, chunk_rows, scores = _best(asking, against, k)
        sizes = np.bincount(asked[query_rows], minlength=len(vec))
        ranks = _places(query_rows) + 1
        hit = against.table.take(pa.array(chunk_rows))
        fields = [
            pa.array(ranks.astype(np.int32)), hit["text"], pa.array(scores),
            hit["source"], hit["chunk_id"],
        ]
        structs = pa.StructArray.from_arrays(
            [f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f for f in fields],
            names=["rank", "text", "score", "source", "chunk_id"],
        )
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), structs)

    return find


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunk.

    A chunk that many queries hit is a hot key, so the hits are staged and looked up with salts.
    """
    def ref() -> Column:
        return F.concat_ws("\x01", "source", "chunk_id").alias("_ref")

    staged = stage(hits.select("*", ref()), "hits")
    texts = chunks.select(ref(), "text")
    return lookup_join(staged, texts, "_ref", hot=hot_keys(staged, "_ref")).drop("_ref")


def collect_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, hits): each query's hits with their texts, in rank order; at most k per query."""
    hit = F.struct("rank", "text", "score", "source", "chunk_id")
    return with_texts(hits, chunks).groupBy("query_id").agg(
        F.array_sort(F.collect_list(hit)).alias("hits")
    )
