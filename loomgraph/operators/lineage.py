"""Cutting the lineage of iterative plans through storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir`` where it is set.

    Only a session on one machine (a local test) without that setting gets a temporary folder; on a cluster
    its lack is an error, as a folder of one machine would not be there for the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The rows survive the loss of any executor; ids that were assigned while the rows were
    computed stay as they are.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
