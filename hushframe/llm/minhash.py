"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (64-bit hashes); a text
   of fewer words than a shingle is one shingle.  Rows with equal sets are one
   class, found and named by a 128-bit digest of the sorted set; only one row of
   each class goes on, so copies never meet as pairs.
2. A class has a signature of MinHash values, cut into bands.  The number of bands
   follows from the threshold and a miss probability, so that a pair at the
   threshold shares a band but for that probability.
3. In a bucket (equal bands) CENTRES of the classes are compared with all others; where the
   bucket's classes are still of several components, each with each, inside tasks.  From
   there only pairs come whose signatures are plausible, and only links from large buckets,
   which are compared in parts, so that no group of near copies becomes a square of rows.
4. A pair's signatures are compared in batches.  After each, the posterior of
   its similarity (binomial likelihood, uniform prior) is looked at: the pair
   goes once the probability of reaching the threshold is below the miss
   probability.
5. Survivors are verified exactly on the full shingle sets of their texts.
6. Links make connected components over classes, and each row takes that of its
   class, named by the smallest key.

Null texts, empty texts and texts without words have an empty set: they link
with nothing, not even each other.  Rows that share a key and differ in text
are different texts: each links by itself, and the key takes the least of their
components.  A null key counts after all others.  Ties go to the smallest key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Batch, Scratch, connected_components, mix, small_batches, window_hashes

#: MinHash values of one band.
ROWS = 5
#: Probability at most that a pair at the threshold shares no band, or is pruned at a batch.
MISS = 1e-8
#: MinHash values compared before the posterior is looked at again.
BATCH = 32
#: Classes of a bucket that all its others are compared with before all are compared with all.
CENTRES = 1
#: Classes of a bucket up to which its plausible pairs are rows; larger buckets are compared in parts inside tasks.
SMALL = 32
#: Classes and shingles of one part.
PART, PART_SHINGLES = 512, 500_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def least_matches(threshold: float, n: int, miss: float = MISS) -> int:
    """The fewest matches among n MinHash values with which P(similarity >= threshold) is still ``miss``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail at the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, size))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(90210)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each function over the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        part = hashes[i : i + 1024, None] * a
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    return low


def describe(df: DataFrame, text: str, key: str, size: int, bands: int, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, digest, signature, bands); signature has 16 bits of each value, bands are hashes of ``rows`` values.

    The last three are null for an empty set.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = Batch(batch.column(1))
            for lo, hi in texts.pieces():
                _, _, _, words, first = texts.words(lo, hi, lower=True)
                count, digest, sign, keys = [], [], [], []
                for i in range(hi - lo):
                    own = shingles(words[first[i] : first[i + 1]], size)
                    count.append(len(own))
                    if not len(own):
                        digest.append(None)
                        sign.append(None)
                        keys.append(None)
                        continue
                    low = signature(own, a, b)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sign.append((low >> np.uint64(48)).astype(np.uint16).tobytes())
                    band = salt.copy()
                    for r in low.reshape(bands, rows).T:
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + r)
                    keys.append(band.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=[key, "n_shingles", "digest", "signature", "bands"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, digest binary, signature binary, bands array<long>")


def _alive(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of signatures stay plausible through all batches of values."""
    alive, matches = np.arange(len(right)), np.zeros(len(right), np.int64)
    for lo in range(0, right.shape[1], BATCH):
        hi = min(lo + BATCH, right.shape[1])
        one = left[lo:hi] if left.ndim == 1 else left[alive, lo:hi]
        matches[alive] += (one == right[alive, lo:hi]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(threshold, hi, miss)]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _plausible(pairs: DataFrame, signs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (u, v) whose posterior stays above the miss probability through all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(_alive(_matrix(batch.column(2)), _matrix(batch.column(3)), threshold, miss))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    both = pairs.join(signs.select(F.col("node").alias("u"), F.col("signature").alias("su")), "u").join(signs.select(F.col("node").alias("v"), F.col("signature").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(run, "u binary, v binary")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * |intersection| >= percent * |union| of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            left, right = Batch(batch.column(2)), Batch(batch.column(3))
            v = batch.column(1).to_pylist()
            good = []
            for i in range(batch.num_rows):
                one = shingles(left.words(i, i + 1, lower=True)[3], size)
                if held[0] != v[i]:
                    held = (v[i], shingles(right.words(i, i + 1, lower=True)[3], size))
                both = len(np.intersect1d(one, held[1], assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(held[1]) - both))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    return both.select("u", "v", "tu", "tv").mapInArrow(run, "u binary, v binary")


def _known(members: DataFrame, component: DataFrame | None) -> DataFrame:
    if component is None:
        return members.withColumn("component", F.col("node"))
    return members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _open(rows: DataFrame, *more: Column) -> DataFrame:
    """(bucket, more) of the buckets whose classes are of several components."""
    wide = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *more)
    return wide.where("lo <> hi").drop("lo", "hi")


def _star_pairs(scratch: Scratch, rows: DataFrame, centres: int) -> DataFrame:
    """(u, v) of (bucket, node, component): v is one of the centres of a bucket of two components, the first of so many orders by hash."""
    first = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) if k else F.min("node") for k in range(centres))))
    # written first: a join right on an aggregate cannot split its hot keys
    chosen = scratch.keep(_open(rows, first.alias("centres")).select("bucket", F.explode("centres").alias("v")))
    named = scratch.keep(chosen.join(rows.select("bucket", F.col("node").alias("v"), F.col("component").alias("cv")), ["bucket", "v"]))
    return rows.join(named, "bucket").where("component <> cv").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()


def _small_pairs(rows: DataFrame, signs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (u, v) of (bucket, node, component) of several components whose signatures are plausible.

    A task reads its buckets one behind the other.  Of the buckets that two classes share, the first compares them.
    """
    rows = rows.join(signs.select("node", "signature", "bands"), "node").select("bucket", "node", "component", "signature", "bands")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "node")

    def compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, sign = part.column("bucket").to_numpy(), _matrix(part.column("signature"))
        bands = np.array(part.column("bands").to_pylist(), dtype=np.int64)
        node, component = (np.array([x.hex() for x in part.column(c).to_pylist()]) for c in ("node", "component"))
        u, v = [], []
        for step in range(1, len(bucket)):
            left = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(left):
                break
            left = left[component[left] != component[left + step]]
            left = left[bands[left, (bands[left] == bands[left + step]).argmax(axis=1)] == bucket[left]]
            left = left[_alive(sign[left], sign[left + step], threshold, miss)] if len(left) else left
            u.append(left)
            v.append(left + step)
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v))
        yield from pa.table({"u": part.column("node").take(pa.array(u)), "v": part.column("node").take(pa.array(v))}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            # the last bucket may go on in the next batch
            cut = int(np.searchsorted(part.column("bucket").to_numpy(), part.column("bucket")[-1].as_py())) if len(part) else 0
            held = part.slice(cut)
            if cut:
                yield from compared(part.slice(0, cut).combine_chunks())
        if held is not None and len(held):
            yield from compared(held.combine_chunks())

    return rows.mapInArrow(run, "u binary, v binary")


def _large_links(rows: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int, miss: float) -> DataFrame:
    """Links (u, v) inside the large buckets of (bucket, node, component, parts).

    A group of rows is two of a bucket's parts, so that a task holds twice a part
    at a time.  Of the buckets that two classes share, the first compares them.
    """
    threshold = percent / 100
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.join(signs.select("node", "signature", "bands"), "node").join(texts, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("bucket", "part", other, "node", "component", "signature", "bands", "text")
    rows = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("second"), "node", "component", "signature", "bands", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bucket, twice = group.column("bucket")[0].as_py(), group.column("i")[0].as_py() != group.column("j")[0].as_py()
        node, second = group.column("node").to_pylist(), group.column("second").to_numpy()
        _, label = np.unique(np.array([x.hex() for x in group.column("component").to_pylist()]), return_inverse=True)
        sign = _matrix(group.column("signature"))
        bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)
        text = Batch(group.column("text"))
        sets = [shingles(text.words(k, k + 1, lower=True)[3], size) for k in range(len(node))]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.array([len(x) for x in sets])
        start = np.concatenate(([0], np.cumsum(n)))
        mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
        links: list[tuple[bytes, bytes]] = []
        for a in np.flatnonzero(~second):
            b = np.flatnonzero(second) if twice else np.arange(a + 1, len(node))
            b = b[(label[b] != label[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a]))]
            same = bands[b] == bands[a]
            b = b[bands[a][same.argmax(axis=1)] == bucket] if len(b) else b
            b = b[_alive(sign[a], sign[b], threshold, miss)] if len(b) else b
            if not len(b):
                continue
            mark[flat[start[a] : start[a + 1]]] = 1
            both = np.add.reduceat(mark[flat], start[:-1])[b] if len(b) > 16 else np.array([mark[flat[start[k] : start[k + 1]]].sum() for k in b])
            mark[flat[start[a] : start[a + 1]]] = 0
            for k in b[100 * both >= percent * (n[a] + n[b] - both)]:
                if label[k] != label[a]:
                    links.append((node[a], node[k]))
                    label[label == label[k]] = label[a]
        return pa.table({"u": pa.array([x for x, _ in links], pa.binary()), "v": pa.array([x for _, x in links], pa.binary())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "u binary, v binary")


def groups(scratch: Scratch, df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(key, n_shingles, component_id) of every key; linked texts have 100 * |intersection| >= percent * |union|."""
    threshold = percent / 100
    base = df.select(F.struct(df[key].alias("key"), F.xxhash64(df[text]).alias("h")).alias("id"), df[text].alias("text"))
    told = scratch.keep(describe(base, "text", "id", size, bands_for(threshold, miss=miss)))
    # a class: equal sets; one of its rows speaks for it
    classes = scratch.keep(told.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id")))
    signs = scratch.keep(told.join(classes, ["digest", "id"]).select(F.col("digest").alias("node"), "n_shingles", "signature", F.array_distinct("bands").alias("bands")).dropDuplicates(["node"]))
    rows = signs.select("node", F.explode("bands").alias("bucket"))
    shared = scratch.keep(rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket"))
    members = scratch.keep(rows.join(shared, "bucket"))
    scratch.release()
    asked = classes.join(members.select(F.col("node").alias("digest")).distinct(), "digest", "left_semi")
    texts = scratch.keep(base.join(asked, "id").select(F.col("digest").alias("node"), "text").dropDuplicates(["node"]))
    scratch.release()

    def verify(pairs: DataFrame) -> DataFrame:
        out = scratch.keep(_verified(scratch.keep(pairs), texts, size, percent))
        scratch.release()
        return out

    links = verify(_plausible(_star_pairs(scratch, _known(members, None), CENTRES), signs, threshold, miss))
    component = scratch.keep(connected_components(scratch, links))
    known = scratch.keep(_known(members, component))
    left = scratch.keep(_open(known.join(signs.select("node", "n_shingles"), "node"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")))
    small = known.join(left.where(F.col("n") <= SMALL).select("bucket"), "bucket")
    links = links.unionByName(verify(_small_pairs(small, signs, threshold, miss)))
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("shingles") / PART_SHINGLES)).cast("int")
    large = known.join(left.where(F.col("n") > SMALL).select("bucket", parts.alias("parts")), "bucket")
    links = links.unionByName(scratch.keep(_large_links(large, signs, texts, size, percent, miss)))
    component = scratch.keep(connected_components(scratch, links))

    placed = told.select("id.key", "n_shingles", F.col("digest").alias("node")).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.keep(placed)
    low = scratch.keep(placed.where("component is not null").groupBy("component").agg(F.min("key").alias("low")))
    out = placed.join(low, "component", "left").groupBy("key").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("low", "key")).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id")
