"""Shared parts of the training-data operators.

* ``Scratch``: tables written below ``spark.checkpoint.dir`` and removed again;
* word tables: vectorised hashing of ``[^\\x20\\x09-\\x0D]+`` words of a batch;
* ``connected_components``: alternating large-star / small-star over link rows.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long documents do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; Spark's default where none is named."""
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


class Scratch:
    """Parquet tables in the shared checkpoint folder; ``drop`` removes them all.

    They cut lineage as ``checkpoint()`` does, survive the loss of executors,
    and are column-pruned when read again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/hushframe-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let go of the shuffle files of frames that nothing refers to any more; Spark removes them once both sides have collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# --------------------------------------------------------------------------
# words

#: The white space that separates words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        for name, base in (("p", _P), ("inv", _P_INV)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["p"], _POWERS["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one prefix sum, moved to a common power."""
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Batch:
    """The texts of an Arrow column as bytes, cut into pieces of about CHUNK_BYTES.

    Null texts count as empty.
    """

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        lo, n = column.offset, len(column)
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[lo : lo + n + 1]
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Row ranges [a, b) with about CHUNK_BYTES of text, one row at least."""
        a, n = 0, len(self.offsets) - 1
        while a < n:
            b = int(np.searchsorted(self.offsets, self.offsets[a] + CHUNK_BYTES, side="right")) - 1
            b = min(max(b, a + 1), n)
            yield a, b
            a = b

    def words(self, a: int, b: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, word starts, word ends, word hashes, first word of each row and the total)."""
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        data = self.data[lo:hi]
        if lower:
            data = _LOWER[data]
        bounds = self.offsets[a : b + 1] - lo
        starts, ends = word_spans(data, bounds)
        return data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a row's bound ends a word as white space does."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    return starts, np.flatnonzero(solid & (~after | cut[1:])) + 1


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, in order; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + n]
    return mix(out)


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As window_hashes, for large k: one prefix sum in place of k steps."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(words) + 1)
    sums = np.empty(len(words) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[:n])


# --------------------------------------------------------------------------
# connected components


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of the links (u, v): component is the smallest node that is reachable.

    Alternating large-star and small-star steps; each is a pre-aggregated
    minimum per node and an equi-join, so that a node with very many links is
    split as any skewed join key.  Nodes without links get no row; null nodes
    are ignored; loops and repeated links do no harm.
    """
    edges = (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    edges = scratch.keep(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u")
        small = (
            small.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = scratch.keep(small)
        # done when every node has one link, to a node that has none itself
        places = edges.select("u", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")).distinct())
        if places.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
