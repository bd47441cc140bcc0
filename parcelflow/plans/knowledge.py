"""Knowledge base: files to chunk table, and retrieval over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.chunks import CHUNK_OVERLAP, CHUNK_SIZE, chunk_text
from ..operators.similarity import topk, with_texts
from ..operators.vector_index import VectorIndex, search_index
from ..sources.knowledge import carrier_folders, overwrite_chunks, read_chunks, read_markdown, replace_carriers
from ..staging import stage

Embed = Callable[[Column], Column]


def chunk_files(
    files: DataFrame, embed: Embed | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """KB_FILES to KB_CHUNKS; without ``embed`` the vectors stay null."""
    chunks = chunk_text(files, "text", size, overlap)
    vec = embed(F.col("text")) if embed else F.lit(None)
    return chunks.withColumn("vec", vec.cast("array<float>"))


def ingest(spark: SparkSession, pattern: str, path: str, embed: Embed) -> DataFrame:
    """Rebuild the chunk table from markdown files; returns the chunk count per file."""
    chunks = chunk_files(read_markdown(spark, pattern), embed)
    overwrite_chunks(chunks, path)
    return ingest_counts(chunks)


@dataclass(frozen=True)
class Changes:
    """What an ingest did: chunks in the table, texts that were embedded, carriers that were written."""

    chunks: int
    embedded: int
    carriers: tuple[str | None, ...]


def ingest_changes(chunks: DataFrame, path: str, embed: Embed) -> Changes:
    """Bring a chunk table to the state of ``chunks`` (source, chunk_id, text, carrier), at the cost of what changed.

    A text that the table holds anywhere keeps its vector; each other text is embedded once, however many chunks
    have it.  Only carriers with a changed, new or missing chunk are written, and readers see the old state until
    all is there.
    """
    spark = chunks.sparkSession
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    new = stage(chunks.select("source", "chunk_id", "text", "carrier", digest), "chunks")
    old = read_chunks(spark, path).select("source", "chunk_id", "carrier", "vec", digest)
    vectors = old.filter("vec IS NOT NULL").groupBy("digest").agg(F.any_value("vec").alias("vec"))
    texts = new.groupBy("digest").agg(F.any_value("text").alias("text"))
    fresh = stage(texts.join(vectors, "digest", "left_anti"), "fresh")
    made = stage(fresh.select("digest", embed(F.col("text")).cast("array<float>").alias("vec")), "vectors")

    key = ["source", "chunk_id"]
    mark = F.lit(1)
    both = new.select(*key, "carrier", "digest", mark.alias("now")).join(
        old.select(*key, F.col("carrier").alias("was"), F.col("digest").alias("old"), mark.alias("before")), key, "full"
    )
    same = F.col("now").isNotNull() & F.col("before").isNotNull() & (F.col("digest") == F.col("old"))
    same = same & F.col("carrier").eqNullSafe(F.col("was"))
    moved = both.filter(~F.coalesce(same, F.lit(False)))
    touched = moved.select(F.explode(F.array(
        F.struct(F.col("now").alias("there"), "carrier"), F.struct(F.col("before").alias("there"), F.col("was").alias("carrier"))
    )).alias("c")).filter("c.there IS NOT NULL").select("c.carrier").distinct()
    changed = [r["carrier"] for r in touched.collect()]  # one row per carrier
    if changed:
        named = F.col("carrier").isin([c for c in changed if c is not None])
        wanted = (named | F.col("carrier").isNull()) if None in changed else named
        kept = {c: f for c, f in carrier_folders(spark, path).items() if c not in changed}
        with_vectors = new.filter(wanted).join(vectors.unionByName(made), "digest")
        replace_carriers(with_vectors, path, kept)
    return Changes(new.count(), made.count(), tuple(sorted(changed, key=lambda c: c or "")))


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per source, and in total under a null source."""
    return chunks.rollup("source").agg(F.count("*").alias("chunks"))


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, index: VectorIndex | None = None) -> DataFrame:
    """Flat hits (query_id, rank, source, chunk_id, text, score) without a carrier filter.

    With ``index``, an index of ``chunks``, only the cells nearest to a query are read.
    """
    return _search(queries.select("query_id", "vec"), chunks, k, index)


def search_kb(queries: DataFrame, chunks: DataFrame, k: int = 4, index: VectorIndex | None = None) -> DataFrame:
    """As ``search``, within the query's carrier where that has any chunk."""
    return _search(queries.select("query_id", "vec", "carrier"), chunks, k, index)


def _search(queries: DataFrame, chunks: DataFrame, k: int, index: VectorIndex | None) -> DataFrame:
    hits = topk(queries, chunks, k) if index is None else search_index(queries, index, k)
    return with_texts(hits, chunks)
