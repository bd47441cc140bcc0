"""The operators of this subpackage as queries over the given tables, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, decontaminate, hilbert, licenses, line_dedup, merkle, minhash, packing, pii, pitman_yor, prefix_trie,
    quality_rules, secret_scan,
)
from .common import documents, span_digests
from .oracles import ORACLES  # noqa: F401
from .settings import TOKENIZERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    return quality_rules.ledger(documents(spark, sf_dir)).select(
        "doc_id", *quality_rules.MEASUREMENTS, "fail_bits", "base_failed", "kept"
    )


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their text, as counts and hashes."""
    return bpe.digests(bpe.encode_documents(documents(spark, sf_dir), TOKENIZERS["word_bpe_49k"]))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, and spans plain and disguised."""
    return pii.digests(pii.scan(documents(spark, sf_dir)))


@query
def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document along the curve, with equal row counts."""
    sharded = hilbert.shard_rows(hilbert.document_rows(documents(spark, sf_dir)))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, and spans of the base kinds and of well-known tokens."""
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", *span_digests(F.col("spans"), tuple(r.kind for r in secret_scan.BASE)))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, exactly or within two edits."""
    found = line_dedup.report(documents(spark, sf_dir), line_dedup.Settings(short_repeats=True))
    return found.withColumn("dropped", F.array_join("dropped", ","))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: shingles of four words, similarity of 0.8 or more."""
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.Settings(words=4))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, verbatim or with other values."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark).drop("text_key")


@query
def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, by the model and by the unigram base."""
    docs = documents(spark, sf_dir)
    return pitman_yor.score(docs, pitman_yor.learn(docs))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, its own or that of the nearest directory.

    The table has no paths: a document lies in its source, in a folder of a thousand ids, in one of fifty.
    """
    folder = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 50)]
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), *folder, F.col("doc_id").cast("string"))
    return licenses.scan(documents(spark, sf_dir).withColumn("path", path))


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document, in sequences of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir), TOKENIZERS["word_bpe_49k"])


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and what it gives for those whose text was changed to lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.translate(f, upper, upper.lower()) if f == "text" else F.col(f) for f in merkle.FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = merkle.manifest(documents(spark, sf_dir), changed=F.when(changed, merkle.leaf_hash(*fields)))
    checked = merkle.verified(proofs, F.coalesce("changed", "leaf"))
    proof = F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return checked.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the conversations, each rebuilt on the first of its five."""
    turns = prefix_trie.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    return prefix_trie.trie(*prefix_trie.branched(turns, base, shared, 8))
