"""Written intermediate tables: they cut lineage and survive the loss of executors.

They lie in the shared folder named by ``spark.checkpoint.dir``.  Those of a job that ends with its own
output are removed with ``scratch``; others stay until the folder's owner clears it, as results may still
read them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one on local masters only."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelflow-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Stage into a folder of its own, which goes when the job has succeeded.

    After a failure it stays, to look into.
    """
    path = f"{staging_dir(spark)}/job-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns as a written table; the tables it staged on the way are removed."""
    path = f"{_folder.get() or staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, so later passes read only their columns."""
    spark = df.sparkSession
    path = f"{_folder.get() or staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
