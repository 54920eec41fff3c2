"""Benchmark passages in documents, with DataFrame functions only.

A document leaks an item if one of its windows of as many words as the item has
a weighted shingle similarity of ``percent`` or more with it: the sum of the
smaller shingle counts by the sum of the larger ones.  Words are runs of letters
and digits in lower case; a shingle is SHINGLE words, or all words of an item
that has fewer.  A document of fewer words than the item is its own window.

1. Lossless prefilter.  With S and T shingles on the sides, a similarity of t needs
   t (S + T) / (1 + t) shingles of the window to occur in the item.  Shingle hashes of
   all documents meet those of all items in one equi-join; (document, item) pairs
   with too few hits go, and only windows that begin at a hit or up to the
   number of admissible misses before one are formed.
2. Each such window gets a 64-bit SimHash of its words, as each item has.
3. Multi-index: the fingerprint is cut into RADIUS + 1 blocks, one of which must
   agree within RADIUS bits, so the join on blocks misses none; then the distance
   itself is taken.
4. Survivors are verified by their exact shingle counts.

The items' shingles are broadcast if there are at most ``BROADCAST_ROWS`` of
them, which is counted first, and shuffled otherwise.

Null or wordless texts and items take no part.  Repeated items are reported
each.  A document is known by its key and text: rows that share a key, or have
none, are judged each by their own text, equal rows together.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Scratch
from hushframe.llm.lines import PACKED_WORDS, normal, simhash

SHINGLE = 5
PERCENT = 80
RADIUS = 16
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; an empty array if it has none."""
    clean = normal(text)
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of every k consecutive entries of an array column."""
    at = lambda i, j: F.get(F.col(words), i + j)
    places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(at(i, j) for j in range(k))))


def blocks(fp: str, radius: int) -> Column:
    """(number, bits) of each of radius + 1 blocks of a fingerprint."""
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)).alias("bits")) for i in range(radius + 1)))


def leaks(scratch: Scratch, docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(key, item_key, start_word, n_words, similarity): the best window, the first of equals, of every document and item that it leaks."""
    told = items.select(F.col(item_key).alias("item"), word_hashes(F.col(item_text)).alias("words")).where("size(words) > 0")
    told = scratch.keep(told.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(SHINGLE))))
    sizes = sorted(r["k"] for r in told.select("k").distinct().collect())
    words = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("doc"), word_hashes(F.col(text)).alias("words")).withColumn("m", F.size("words"))
    none = told.where("false")
    hits = None
    wanted = {}
    for k in sizes:
        own = told.where(F.col("k") == k).select("item", "n", F.explode(shingle_hashes("words", k)).alias("h"))
        wanted[k] = own
        index = scratch.keep(own.select("item", "n", "h").distinct())
        if index.count() <= BROADCAST_ROWS:
            index = F.broadcast(index)
        found = words.select("doc", "m", F.posexplode(shingle_hashes("words", k)).alias("at", "h")).join(index, "h").select("doc", "m", "item", "n", F.lit(k).alias("k"), "at")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = words.select("doc", "m").join(none.select("item", "n", "k"), F.lit(False)).withColumn("at", F.lit(0))
    # shingles of a window (s) and of the item (t); a document that is shorter than the item is one window
    hits = hits.withColumn("s", F.least("m", "n") - F.col("k") + 1).withColumn("t", F.col("n") - F.col("k") + 1)
    need = F.ceil(F.lit(percent) * (F.col("s") + F.col("t")) / F.lit(100 + percent)).cast("int")
    places = hits.groupBy("doc", "m", "item", "n", "k", "s", "t").agg(F.array_sort(F.collect_set("at")).alias("at"))
    places = places.where(F.size("at") >= need).withColumn("slack", F.col("s") - need)
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(p - F.col("slack"), F.lit(0)), p))))
    starts = F.when(F.col("m") < F.col("n"), F.array(F.lit(0))).otherwise(starts)
    per = scratch.keep(places.select("doc", F.struct("item", F.least("m", "n").alias("n"), "k", "s", "t", starts.alias("starts")).alias("c")).groupBy("doc").agg(F.collect_list("c").alias("cs")))
    asked = words.join(per, "doc").select("doc", "words", F.explode("cs").alias("c"))
    cut = F.transform(F.filter("c.starts", lambda p: p + F.col("c.n") <= F.size("words")), lambda p: F.struct(p.alias("start"), F.slice("words", p + 1, F.col("c.n")).alias("words")))
    windows = asked.select("doc", F.col("c.item").alias("item"), F.col("c.n").alias("n"), F.col("c.k").alias("k"), F.col("c.s").alias("s"), F.col("c.t").alias("t"), F.explode(cut).alias("w"))
    windows = scratch.keep(windows.select("doc", "item", "n", "k", "s", "t", "w.start", "w.words").dropDuplicates(["doc", "item", "start"]))
    packed = (F.col("n") <= PACKED_WORDS).alias("packed")
    prints = scratch.keep(simhash(windows.select("doc", "item", "start", F.explode("words").alias("h"), packed), "doc", "item", "start"))
    item_prints = simhash(told.select("item", F.explode("words").alias("h"), packed), "item").withColumnRenamed("fp", "item_fp")
    left = prints.select("doc", "item", "start", "fp", F.explode(blocks("fp", radius)).alias("b")).select("doc", "item", "start", "fp", "b.*")
    right = item_prints.select("item", "item_fp", F.explode(blocks("item_fp", radius)).alias("b")).select("item", "item_fp", "b.*")
    near = left.join(right, ["item", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("doc", "item", "start").distinct()
    checked = windows.join(near, ["doc", "item", "start"], "left_semi")
    out = None
    for k in sizes:
        counts = checked.where(F.col("k") == k).select("doc", "item", "start", "n", "s", "t", F.explode(shingle_hashes("words", k)).alias("h"))
        counts = counts.groupBy("doc", "item", "start", "n", "s", "t", "h").agg(F.count("*").alias("c"))
        own = wanted[k].groupBy("item", "h").agg(F.count("*").alias("d"))
        both = counts.join(own, ["item", "h"]).groupBy("doc", "item", "start", "n", "s", "t").agg(F.sum(F.least("c", "d")).alias("both"))
        out = both if out is None else out.unionByName(both)
    if out is None:
        out = checked.select("doc", "item", "start", "n", "s", "t", F.lit(0).cast("long").alias("both"))
    out = out.where(f"100 * both >= {percent} * (s + t - both)")
    best = out.groupBy("doc", "item", "n", "s", "t").agg(F.max("both").alias("both"), F.max(F.struct("both", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("doc.key").alias(key), F.col("item").alias(item_key), (-F.col("best.back")).cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"), (F.col("both") / (F.col("s") + F.col("t") - F.col("both"))).alias("similarity"))
