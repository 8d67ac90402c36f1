"""Readers for the columnar tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file that are worth a task of their own where work on texts follows.
TASK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the directory; Parquet file or folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan dealt out to all cores where its files have fewer row groups than there are cores.

    Only small inputs are moved, by a hash of ``key``: a scan of as many partitions as there are cores stays
    as it is.
    """
    sc = rows.sparkSession.sparkContext
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = min(sc.defaultParallelism, size // TASK_BYTES + 1)
    return rows.repartition(want, key) if rows._jdf.rdd().getNumPartitions() < want else rows
