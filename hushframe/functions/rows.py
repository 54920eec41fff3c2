"""Where rows are cut off from what made them, and how few splits become many."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the checkpoint folder, for plans that name it several times.

    The folder is the one that the session names in spark.checkpoint.dir; a session
    without one gets a folder of its own, which only a local session can share.  A stream
    is left as it is: it is read once in any case.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def spread(df: DataFrame, times: int = 3) -> DataFrame:
    """``df`` dealt to ``times`` as many tasks as there are cores, if its source has fewer splits than cores.

    For texts that are dear to read through and few to scan; large sources have splits
    enough and are not shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * times) if df.rdd.getNumPartitions() < cores else df
