"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelflow.staging import staging_dir

# Arrow's own pool keeps what was freed; the system's gives it back, and workers stay alive for long.
pa.set_memory_pool(pa.system_memory_pool())

#: Texts handled at a time inside an Arrow batch, in bytes (a single longer text is one piece).
PIECE_BYTES = 1 << 20
#: Arrow batches are cut at this size, so long texts do not add up in a worker.
BATCH_BYTES = "4m"
#: A side may be broadcast only if it has at most this many rows (of a few dozen bytes).
BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_checkpoints(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` write to the shared folder of the session."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(staging_dir(spark))


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted




def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, so that working arrays stay small."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield texts.slice(start)


def whole_texts(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with null as empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.string()), "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of other than ASCII white space) of a piece, and the text each belongs to."""
    split = pc.ascii_split_whitespace(texts)
    words, text = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), text[real.to_numpy(zero_copy_only=False)]


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (a stored table) has few enough rows to be broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(df, rows) else df


def span_digests(found: Column, kinds: tuple[str, ...]) -> list[Column]:
    """Counts of plain spans by kind, the hash of the plain ones, all spans as text, those added."""

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    plain = F.filter(found, lambda s: s["plain"])

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [
        *map(count, kinds),
        F.sha2(listed(plain).cast("binary"), 256).alias("base_sha256"),
        listed(found).alias("spans"),
        (F.size(found) - F.size(plain)).cast("bigint").alias("n_added"),
    ]
