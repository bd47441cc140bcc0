"""Knowledge-base files and the chunk table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.text import strip

# --- fixed values -------------------------------------------------------------------------------
CARRIER_MARKS = [
    ("Shipping_A", ["shipping_a", "company_a"]),
    ("Shipping_B", ["shipping_b", "company_b"]),
    ("Shipping_C", ["shipping_c", "company_c"]),
]
SKIPPED_FILE = "readme.md"
# ------------------------------------------------------------------------------------------------


def carrier_from_source(source: Column) -> Column:
    """Carrier whose mark the file name holds; the first in list order, else null."""
    name = F.lower(source)
    return F.coalesce(
        *[
            F.when(name.contains(mark), F.lit(carrier))
            for carrier, marks in CARRIER_MARKS
            for mark in marks
        ]
    )


def kb_files(files: DataFrame) -> DataFrame:
    """KB_FILES rows from (source, text): stripped, without the readme and blank files."""
    return (
        files.filter(F.lower("source") != SKIPPED_FILE)
        .select("source", strip(F.col("text")).alias("text"))
        .filter(F.char_length("text") > 0)
        .withColumn("carrier", carrier_from_source(F.col("source")))
    )


def read_markdown(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files under a glob as KB_FILES."""
    files = spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")
    )
    return kb_files(files)


# A chunk table is a folder with ``data-*`` folders, each partitioned by carrier, and ``manifests``: one row per carrier
# that names the data folder it is read from.  A new state is written next to the old one and shows with its manifest,
# which is named last, so readers see the old state or the new one and never a gap.


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the states of a chunk table, oldest first."""
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())


def carrier_folders(spark: SparkSession, path: str, version: int | None = None) -> dict[str | None, str]:
    """The data folder of each carrier in a state, the newest one if none is named."""
    known = versions(spark, path)
    if not known:
        return {}
    rows = spark.read.schema("carrier string, folder string").json(f"{path}/manifests/v{version or known[-1]:08d}")
    return {r["carrier"]: r["folder"] for r in rows.collect()}  # one per carrier


def _publish(spark: SparkSession, path: str, folders: dict[str | None, str]) -> int:
    """Write a manifest and give it its number: a rename, which fails if another writer was faster."""
    number = (versions(spark, path) or [0])[-1] + 1
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    rows = spark.createDataFrame(list(folders.items()), "carrier string, folder string")
    rows.coalesce(1).write.option("ignoreNullFields", False).json(draft)
    fs, target = _fs(spark, f"{path}/manifests/v{number:08d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
        raise RuntimeError(f"another writer changed {path}")
    return number


def replace_carriers(chunks: DataFrame, path: str, keep: dict[str | None, str] | None = None) -> int:
    """Publish a state in which the carriers of ``chunks`` are new and those of ``keep`` stay in their folders."""
    spark = chunks.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    rows = chunks.select(*StructType.fromDDL(schemas.KB_CHUNKS).names)
    rows.write.partitionBy("carrier").parquet(f"{path}/{folder}")
    stored = spark.read.schema(schemas.KB_CHUNKS).parquet(f"{path}/{folder}")
    new = [r["carrier"] for r in stored.select("carrier").distinct().collect()]
    return _publish(spark, path, {**(keep or {}), **dict.fromkeys(new, folder)})


def overwrite_chunks(chunks: DataFrame, path: str) -> bool:
    """Replace the chunk table; an empty input writes nothing.  Returns whether it wrote."""
    if chunks.isEmpty():
        return False
    replace_carriers(chunks, path)
    return True


def read_chunks(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunk table (or an earlier state of it), or no rows if there is none."""
    folders = carrier_folders(spark, path, version)
    out = spark.createDataFrame([], schemas.KB_CHUNKS)
    for folder in sorted(set(folders.values())):
        own = [c for c, f in folders.items() if f == folder]
        named = F.col("carrier").isin([c for c in own if c is not None])
        wanted = (named | F.col("carrier").isNull()) if None in own else named
        out = out.unionByName(spark.read.schema(schemas.KB_CHUNKS).parquet(f"{path}/{folder}").filter(wanted))
    return out


def remove_old_states(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest states, and data folders that none of those reads."""
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in carrier_folders(spark, path, v).values()}
    fs, folder = _fs(spark, path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in used:
            fs.delete(status.getPath(), True)
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifests/v{v:08d}")[1], True)
