"""Tokens that keep their numbers across runs: a table of numbers that grows by increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.operators.dataset import batch_tokens
from hushframe.operators.transform import token_text

_SHAPE = "type string, value string, number long, run long"


class TokenRegistry:
    """Numbers of (type, value) below ``path``, an increment ``run=N`` for each run.

    A value that an earlier run numbered keeps its number; new ones get the next, by
    their first appearance.  A run that is repeated numbers as it did: it leaves its own
    increment and those of later runs out of account, and writes its own anew.  Runs are
    numbered upwards and one at a time.  The table holds the values themselves; it is as
    sensitive as the payloads.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def numbers(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(type, value, number, run) of all runs, or of those before one."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            return spark.createDataFrame([], _SHAPE)
        known = spark.read.schema(_SHAPE).parquet(self.path)
        return known if before is None else known.where(F.col("run") < before)

    def assign(self, facts: DataFrame, run: int) -> DataFrame:
        """(type, value, number, token) of the values of ``facts`` (file_no, op_no, start, type, value), new ones added to the table.

        Known values leave by an anti-join before anything is numbered, so a run costs its
        own values and one read of the table.
        """
        spark = facts.sparkSession
        known = self.numbers(spark, run)
        own = facts.select("type", "value").distinct()
        fresh = batch_tokens(facts.join(known.select("type", "value"), ["type", "value"], "left_anti")).select("type", "value", F.col("number").alias("place"))
        last = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
        new = fresh.crossJoin(F.broadcast(last)).select("type", "value", (F.col("place") + F.col("last")).cast("long").alias("number"))
        new.write.mode("overwrite").parquet(f"{self.path}/run={run}")
        told = own.join(self.numbers(spark, run + 1), ["type", "value"]).select("type", "value", "number")
        return told.withColumn("token", token_text(F.col("type"), F.col("number")))

    def conflicts(self, spark: SparkSession) -> DataFrame:
        """(type, value, numbers) of values that more than one run numbered, as two runs at once would."""
        seen = Window.partitionBy("type", "value")
        rows = self.numbers(spark).withColumn("n", F.count("*").over(seen)).where("n > 1")
        return rows.groupBy("type", "value").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
