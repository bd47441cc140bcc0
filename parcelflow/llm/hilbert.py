"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to a few bits, the cells are numbered along the curve, and the sorted
table is cut into runs.  Neighbours on the curve are near in every dimension, so the smallest and
largest values that the manifest keeps for a shard rule out most shards for a filter on any of them.

The curve index comes from a table of states, one look-up per bit.  The global order is made by one
range exchange of narrow rows; positions within a task and the row counts of tasks before it give the
rank, so no task sees more than its range, and a cell that holds a third of all rows is cut by id.

Null values lie in the first cell of their dimension, a null text has no bytes, an empty table gives
an empty one.  Rows that are equal in index, id and text are ordered arbitrarily but only once.
Columns of the input other than those of the dimensions, ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelflow.staging import stage

from .places import places

BITS = 8
SHARDS = 24
IN_TASK = (1 << 33) - 1  # the lower bits of Spark's increasing ids count rows of a task


def _rotate_left(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For state * 2^n + cell: the digit of the curve, and the next state.

    A state is where the curve enters a cube (a corner) and the axis along which it leaves; the
    corners of a cube are visited in Gray code order, turned into that state.
    """
    size = 1 << n

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def entry(i: int) -> int:
        i = 2 * ((i - 1) // 2) if i else 0
        return i ^ (i >> 1)

    def axis(i: int) -> int:
        return (trailing_ones(i if i % 2 else i - 1) if i else 0) % n

    rank = {i ^ (i >> 1): i for i in range(size)}  # inverse of the Gray code
    digits, states = [], []
    for corner in range(size):
        for along in range(n):
            for cell in range(size):
                digit = rank[_rotate_left(cell ^ corner, n - (along + 1) % n, n)]
                digits.append(digit)
                next_corner = corner ^ _rotate_left(entry(digit), along + 1, n)
                states.append(next_corner * n + (along + axis(digit) + 1) % n)
    return digits, states


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the curve of a cell given by one number below ``2 ** bits`` for each dimension."""
    n = len(cells)
    digits, states = (F.array(*map(F.lit, t)) for t in curve_tables(n))
    state: Column = F.lit(0)
    index = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        corner = reduce(
            Column.bitwiseOR,
            [F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), d) for d, c in enumerate(cells)],
        )
        at = (state * F.lit(1 << n) + corner).cast("int")
        index = index + F.shiftleft(F.get(digits, at).cast("bigint"), n * bit)
        state = F.get(states, at)
    return index


def even_cells(value: Column, low: float, high: float, bits: int = BITS) -> Column:
    """Cells of equal width between the smallest and the largest value."""
    share = (value.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low) + 1.0)
    return _cell(F.floor(share * F.lit(1 << bits)), bits)


def log_cells(value: Column, bits: int = BITS) -> Column:
    """Cells of equal ratio, for sizes."""
    return _cell(F.floor(F.log2(value.cast("double") + 1) * F.lit((1 << bits) / 40)), bits)


def name_cells(value: Column, bits: int = BITS) -> Column:
    """A cell for each name, by its hash."""
    return _cell(F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(1 << bits))), bits)


def _cell(number: Column, bits: int) -> Column:
    bounded = F.least(F.greatest(number, F.lit(0)), F.lit((1 << bits) - 1))
    return F.coalesce(bounded, F.lit(0)).cast("int")


def with_curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32`` and ``curve``, replacing columns of those names.

    The dimensions are the id, the size, the source and the language.
    """
    seen = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    text = F.coalesce(F.col("text"), F.lit(""))
    cells = [
        even_cells(F.col("doc_id"), seen["low"] or 0, seen["high"] or 0, bits),
        log_cells(F.col("size"), bits),
        name_cells(F.col("source"), bits),
        name_cells(F.col("lang"), bits),
    ]
    measured = docs.withColumns(
        {"size": (F.octet_length(text) + 8).cast("bigint"), "text_crc32": F.crc32(text.cast("binary"))}
    )
    return measured.withColumn("curve", hilbert_index(cells, bits))


def document_rows(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Narrow rows of documents: id, size, checksum, dimensions and curve index."""
    return with_curve(docs, bits).select("doc_id", "source", "lang", "size", "text_crc32", "curve")


ORDER = ["curve", "doc_id", "text_crc32", "size"]


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with their global ``rank`` from 0 along ORDER, and ``total`` rows."""
    ordered = stage(rows, "curve").repartitionByRange(_tasks(rows), *ORDER).sortWithinPartitions(*ORDER)
    # Written, so that the ids of the tasks hold for all that follows.
    held = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33).alias("part")
    sizes = held.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = sizes.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    place = F.col("start") + F.col("at").bitwiseAND(F.lit(IN_TASK))
    return held.withColumn("part", part).join(F.broadcast(starts), "part").select(
        *rows.columns, place.alias("rank"), "total"
    )


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shard_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut the curve into runs whose row counts differ by one at most: adds ``shard`` and ``slot``."""
    cut = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked(rows)
        .withColumn("shard", cut)
        .withColumn("slot", F.col("rank") - first)
        .withColumn("shard", F.col("shard").cast("int"))
        .drop("rank", "total")
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes, and the smallest and largest value of every dimension."""
    bounds = [
        f(c).alias(f"{name}_{c}")
        for c in ("doc_id", "size", "source", "lang", "curve")
        for name, f in (("min", F.min), ("max", F.max))
    ]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)


def shards_for(files: DataFrame, **bounds: tuple) -> DataFrame:
    """Shards of a manifest that can hold rows with the given (low, high) in every dimension."""
    for name, (low, high) in bounds.items():
        files = files.filter((F.col(f"max_{name}") >= F.lit(low)) & (F.col(f"min_{name}") <= F.lit(high)))
    return files.select("shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write ``docs`` as one folder per shard, in the curve's order; returns the manifest of what was written.

    A row's shard is told by the first keys of the shards, so texts move once and only to be written.  Rows with the
    key that begins a shard may lie on both sides of the cut: those are placed, and cut by their place.
    """
    order = stage(ranked(document_rows(docs)), "ranked")
    cut = F.expr(f"cast(rank * {shards} div total as int)")
    sharded = order.withColumn("shard", cut)
    start = F.min(F.struct("rank", *ORDER[:3])).alias("first")
    firsts = [r["first"] for r in sharded.groupBy("shard").agg(start).orderBy("shard").collect()]
    out = with_curve(docs).withColumn("_key", _key_text())
    if firsts:
        own = _key(*map(F.col, ORDER[:3]))
        passed = [(own >= _key(*(F.lit(r[c]) for c in ORDER[:3]))).cast("int") for r in firsts]
        begun = F.broadcast(
            order.withColumn("_key", _key_text()).join(_keys_of(sharded, firsts), "_key", "left_semi")
            .groupBy("_key").agg(F.min("rank").alias("start"), F.max("total").alias("total"))
        )  # a row per shard at most
        split = stage(out.join(begun, "_key"), "split")
        split = places(split, ["_key"], ["doc_id"], "_place", "_size").withColumn("rank", F.col("start") + F.col("_place"))
        split = split.withColumn("shard", cut).select(*out.columns, "shard")
        shard = reduce(Column.__add__, passed, F.lit(0)) - 1
        # Shards that begin with the same key count it together; no row with such a key is left here.
        ids = sorted({r["shard"] for r in sharded.select("shard").distinct().collect()})
        shard = F.get(F.array(*map(F.lit, ids)), shard)
        out = out.join(begun, "_key", "left_anti").withColumn("shard", shard).unionByName(split)
    else:
        out = out.withColumn("shard", F.lit(0))
    ordered = out.repartitionByRange(_tasks(docs), "shard", "curve", "doc_id").sortWithinPartitions("shard", "curve")
    ordered.drop("_key", "size", "text_crc32", "curve").write.partitionBy("shard").parquet(path)
    spark = docs.sparkSession
    return manifest(with_curve(spark.read.schema(docs.select("*", F.lit(0).alias("shard")).schema).parquet(path)))


def _key_text() -> Column:
    """What tells rows apart along the curve, as text; null has a sign of its own."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ORDER])


def _keys_of(sharded: DataFrame, firsts: list) -> DataFrame:
    """The keys that shards begin with."""
    at = [r["rank"] for r in firsts]
    return F.broadcast(sharded.filter(F.col("rank").isin(at)).select(_key_text().alias("_key")).distinct())


def _key(*parts: Column) -> Column:
    lowest = F.lit(-(1 << 63)).cast("bigint")
    return F.struct(*[F.coalesce(p.cast("bigint"), lowest).alias(c) for p, c in zip(parts, ORDER)])
