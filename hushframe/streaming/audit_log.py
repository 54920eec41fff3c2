"""The audit log as the sink of a stream: batches of JSON lines in one hash chain."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators.audit import EVENT, around_link
from hushframe.sources.corpus import read_events, read_lines_in_order

_HEAD = "seq long, event_hash string"


class ChainedLog:
    """Appends the events of micro-batches to the log below ``path``; for ``foreachBatch``.

    A batch is a folder ``events/batch=N`` and its head, the hash that the next one is linked
    to, a row of ``heads/batch=N``.  The head is written last, so it commits the batch: a
    batch that has one is not written again, and what a failed attempt left of one that has
    none is written over.  A head links to the newest head before it.

    A chain is one sequence, so one task makes the hashes of a batch, in the order of
    timestamp and event id, from canonical texts that all tasks prepare; it holds one record
    at a time.  The size of a batch is the source's to bound.
    """

    def __init__(self, path: str, key: bytes | None = None) -> None:
        self.path, self.key = path.rstrip("/"), key

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        heads = self.heads(spark)
        if not heads.where(F.col("batch") == batch).isEmpty():
            return
        head = heads.where(F.col("batch") < batch).orderBy(F.desc("batch")).select("seq", "event_hash").first()
        seq, last = (head["seq"], head["event_hash"]) if head else (0, "")
        chained = self._chained(events, seq, last)
        chained.select("value").write.mode("overwrite").option("compression", "none").text(f"{self.path}/events/batch={batch:012d}")
        written = read_lines_in_order(spark, f"{self.path}/events/batch={batch:012d}", "*.txt")
        told = written.agg(F.count("*").alias("n"), F.get_json_object(F.max_by("line", "seq"), "$.event_hash").alias("event_hash"))
        told = told.select((F.lit(seq) + F.col("n")).alias("seq"), F.coalesce("event_hash", F.lit(last)).alias("event_hash"))
        told.coalesce(1).write.mode("overwrite").json(f"{self.path}/heads/batch={batch:012d}")

    def heads(self, spark: SparkSession) -> DataFrame:
        """(seq, event_hash, batch) of the batches that are committed."""
        fs = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            return spark.createDataFrame([], _HEAD + ", batch long")
        return spark.read.schema(_HEAD + ", batch long").json(f"{self.path}/heads")

    def _chained(self, events: DataFrame, seq: int, last: str) -> DataFrame:
        key = self.key
        names = [f.split()[0] for f in EVENT.split(", ")]
        full = events.select(*(F.col(n) if n in events.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in EVENT.split(", "))))
        before, behind = around_link()
        plain = F.to_json(F.struct(*(n for n in names if n not in ("prev_hash", "event_hash"))))
        texts = full.select("timestamp", "event_id", before.alias("before"), behind.alias("behind"), plain.alias("plain"))

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            previous = last
            for batch in batches:
                out = []
                for head, tail, record in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                    text = f"{head}{previous}{tail}".encode()
                    own = hmac.new(key, text, hashlib.sha256).hexdigest() if key else hashlib.sha256(text).hexdigest()
                    out.append(f'{record[:-1]}{"," * (len(record) > 2)}"prev_hash":{json.dumps(previous)},"event_hash":"{own}"}}')
                    previous = own
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

        return texts.repartition(1).sortWithinPartitions("timestamp", "event_id").mapInArrow(link, "value string")

    def events(self, spark: SparkSession) -> DataFrame:
        """(file, seq, event fields, broken) of the committed batches, in the order of the chain."""
        told = read_events(spark, f"{self.path}/events", "*.txt")
        batch = F.regexp_extract("file", r"/batch=(\d+)/", 1).cast("long")
        return told.withColumn("batch", batch).join(F.broadcast(self.heads(spark).select("batch")), "batch", "left_semi").drop("batch")


def write_audit(events: DataFrame, path: str, checkpoint: str, key: bytes | None = None) -> Callable:
    """A started query that appends a stream of audit events to the chained log, once for each batch."""
    return events.writeStream.foreachBatch(ChainedLog(path, key)).option("checkpointLocation", checkpoint)
