"""The corpus pipeline: stages that each hand the documents they keep to the next as Parquet.

Each stage takes (spark, docs, sf_dir), works on all of ``docs``, and returns their columns, but for the last
one, which returns the encoded documents.

Null and empty texts have too few words for the first stage and go there; a text of any length is taken whole.  Rows
without an id are kept where their text is, as are rows that repeat an id: each is judged by its own text, so of
copies the one with the smallest id stays, and rows that are equal in id and text stay or go together.  Columns
beside those of documents are carried along, whatever their names, up to the last stage.  An empty table passes as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import bpe, decontaminate, line_dedup, minhash, quality_rules
from parcelflow.llm.settings import TOKENIZERS
from parcelflow.staging import staging_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality_rules.judge(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, and without those of which nothing is left."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return minhash.without_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, verbatim or with other values."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left (packed unsigned 32-bit integers), with counts and hashes."""
    rows = bpe.encode_documents(docs, TOKENIZERS["word_bpe_49k"])
    return bpe.digests(rows, "ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encoding", encoded),
]

#: Components, edit joins over all lines and merges of a tokenizer are not for SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder."""
    folder = f"{staging_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
