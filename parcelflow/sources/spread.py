"""Parallelism for small inputs."""

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deal out the rows of a file scan that has fewer splits than there are cores.

    Text jobs are bound by CPU, and a small file is one split.  Inputs with enough splits are
    returned as they are, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
