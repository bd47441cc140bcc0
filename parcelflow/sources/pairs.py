"""JSON-lines pair sets and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def write_pairs(pairs: DataFrame, path: str, shuffle_key: str | None = None) -> None:
    """One JSON object per line under ``split=train`` and ``split=val``.

    With ``shuffle_key`` (a seeded hash) the lines come in that order across the files.
    """
    if shuffle_key:
        pairs = pairs.repartitionByRange("split", shuffle_key).sortWithinPartitions("split", shuffle_key)
    pairs.select("input", "assistant_response", "split").write.mode("overwrite").partitionBy(
        "split"
    ).json(path)


def read_pairs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    pairs = spark.read.schema(f"{schemas.SFT_PAIRS}, split string").json(path)
    return pairs.filter(F.col("split") == split) if split else pairs


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(path)
