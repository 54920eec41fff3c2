"""Alignment of two tokenizers' tokens by the bytes that they cover.

A is a byte-level BPE vocabulary of the ``tokenizers`` library, B a ``sentencepiece`` model
with byte fallback; their paths are parameters.  A encodes a space and the text, B the text,
before which it puts a space itself, both with the strings of special tokens as plain text.
A token covers a range of the bytes of space + text; an A and a B token whose ranges overlap
are linked, and places where both end part the tokens into groups.

The merge of the two token sequences runs in lockstep: one state vector holds a pair of
pointers for each lane, and each step emits the links of all lanes, marks the cuts, moves the
pointers of the tokens that end first, and drops the lanes that are done.  A document is a
lane; a long one is as many lanes as it has LANE tokens, each of which starts at its own pair of
pointers, so that it does not hold up a batch.

The links of a batch are kept as places in the batch's sorted table of id pairs.  Corpus-wide
counts add up these tables, one row for each batch and pair, and each batch gets back the
counts of its own pairs, so that nothing is broadcast but the highest count of each B id.

Texts that are null or empty, or whose joined A or B bytes are not space + text (such as those
that hold U+2581, which B reads as a space), have no tokens: zeros and an empty string of
groups.  Repeated rows count as often as they are there; an empty table gives no rows; only
the key and the text are read.  Whole texts are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.bpe import encoder
from hushframe.llm.common import Batch, Scratch, small_batches

#: A tokens of one lane; a text that has more is cut into several.
LANE = 256

#: Fixed value: the character by which B writes a space.
SPACE_MARK = "▁"


class Vocabularies:
    """Both tokenizers, and the bytes of every token."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a, self.b = encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = max(self.a.piece) + 1
        self.a_bytes = [self.a.piece.get(i, b"") for i in range(n)]
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        # what each token adds to the string of groups, within its side of a group and as its last
        self.shown = [f"{i}{end}" for i in range(n) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.b_shown = 2 * n

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """A and B ids; none if the bytes of B are not those of space + text; merges of A's bytes always are."""
        if not text:
            return [], []
        whole = " " + text
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole.encode():
            return [], []
        return self.a.encode_plain(whole), b


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


class Merged(NamedTuple):
    """Links in the order of the text, and whether each token ends a group."""

    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray


def lockstep(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, lane: int = LANE) -> Merged:
    """Merge of all documents of a batch, laid end to end.

    ``a_end`` and ``b_end`` are the ends of the tokens in the joined bytes; both sides
    cover the same bytes, document by document.  ``starts`` are the first A tokens of the
    documents and the number of all.
    """
    n = len(a_end)
    a_last, b_last = np.zeros(n, bool), np.zeros(len(b_end), bool)
    firsts = [np.arange(lo, hi, lane) for lo, hi in zip(starts[:-1], starts[1:]) if hi > lo]
    i = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    stop = np.append(i[1:], n)
    begin = np.where(i > 0, a_end[i - 1], 0) if n else i
    j = np.searchsorted(b_end, begin, side="right")
    out_a, out_b = [], []
    while len(i):
        out_a.append(i)
        out_b.append(j)
        end_a, end_b = a_end[i], b_end[j]
        cut = end_a == end_b
        a_last[i[cut]] = True
        b_last[j[cut]] = True
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not out_a:
        none = np.zeros(0, np.int64)
        return Merged(none, none, a_last, b_last)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    # a link's place: every link before it moved one pointer on, or both at a cut
    at = a + b - (np.cumsum(a_last) - a_last)[a]
    in_order_a, in_order_b = np.empty_like(a), np.empty_like(b)
    in_order_a[at], in_order_b[at] = a, b
    return Merged(in_order_a, in_order_b, a_last, b_last)


def _groups(v: Vocabularies, a: np.ndarray, b: np.ndarray, merged: Merged, bounds: np.ndarray) -> list[str]:
    """The string of groups of each document: A ids, a bar, B ids, and a semicolon between groups."""
    a_group, b_group = np.cumsum(merged.a_last) - merged.a_last, np.cumsum(merged.b_last) - merged.b_last
    a_upto, b_before = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group)) - np.bincount(b_group)
    shown = np.empty(len(a) + len(b), np.int64)
    if len(a):
        shown[np.arange(len(a)) + b_before[a_group]] = 2 * a + merged.a_last
        shown[np.arange(len(b)) + a_upto[b_group]] = v.b_shown + 2 * b + merged.b_last
    table = v.shown
    return ["".join(map(table.__getitem__, shown[lo:hi].tolist()))[:-1] for lo, hi in zip(bounds[:-1], bounds[1:])]


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of documents: block, key, n_a, n_b, n_groups, ``groups``, ``links``; and a row for each block: ``pairs``, ``counts``.

    A block is what one step of a task aligned, about CHUNK_BYTES of text.  ``pairs`` are its distinct id pairs,
    A id * 2^32 + B id, in order, and ``counts`` how many links hold each; ``links`` are
    the places in ``pairs`` of a document's links, in the order of its text.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 33
        pieces = (batch.slice(lo, hi - lo) for batch in batches for lo, hi in Batch(batch.column(1)).pieces())
        for block, batch in enumerate(pieces, block):
            n = batch.num_rows
            both = [v.tokens(t.as_py()) for t in batch.column(1)]
            a_bound, b_bound = (np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x[s]) for x in both], dtype=np.int64)]) for s in (0, 1))
            a, b = (np.fromiter(chain.from_iterable(x[s] for x in both), dtype=np.int32, count=int(bound[-1])) for s, bound in ((0, a_bound), (1, b_bound)))
            del both
            merged = lockstep(np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b]), a_bound)
            groups = np.concatenate([np.zeros(1, np.int64), np.cumsum(merged.a_last)])[a_bound]
            texts = _groups(v, a, b, merged, a_bound + b_bound)
            link_bound = a_bound + b_bound - groups
            pairs, links, counts = np.unique((a[merged.a].astype(np.int64) << 32) | b[merged.b], return_inverse=True, return_counts=True)
            flat = pa.ListArray.from_arrays(pa.array(link_bound, pa.int32()), pa.array(links, pa.int32()))
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), batch.column(0), *(pa.array(np.diff(x), pa.int64()) for x in (a_bound, b_bound, groups)), pa.array(texts, pa.string()), flat, none(pa.list_(pa.int64()), n), none(pa.list_(pa.int64()), n)],
                names=names,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), none(batch.schema.types[0], 1), *(none(pa.int64(), 1) for _ in range(3)), none(pa.string(), 1), none(pa.list_(pa.int32()), 1), *(pa.array([x], pa.list_(pa.int64())) for x in (pairs, counts))],
                names=names,
            )

    kind = df.schema[key].dataType.simpleString()
    names = ["block", key, "n_a", "n_b", "n_groups", "groups", "links", "pairs", "counts"]
    return df.select(key, text).mapInArrow(run, f"block long, `{key}` {kind}, n_a long, n_b long, n_groups long, groups string, links array<int>, pairs array<long>, counts array<long>")


def pair_counts(scratch: Scratch, aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold each id pair, and whether no other pair of its B id has more."""
    each = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("e"))
    total = scratch.keep(each.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.counts").alias("count")))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    best = scratch.keep(total.groupBy(b_id).agg(F.max("count").alias("most")))  # as many rows as B has ids
    return total.withColumn("b", b_id).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(scratch: Scratch, aligned: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ("n_a", "n_b", "n_groups", "groups")) -> DataFrame:
    """(key, carry.., n_links, n_best, count_sum) of each document of a kept ``align`` table.

    n_best counts the links whose pair is the most frequent of its B id, ties included;
    count_sum adds up the counts of the links' pairs.
    """
    counted = pair_counts(scratch, aligned)
    own = aligned.where("pairs is not null").select("block", F.explode("pairs").alias("pair"))
    told = own.join(counted, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("own"))
    told = told.select("block", F.lit(False).alias("doc"), F.expr("transform(own, x -> x.count)").alias("counts"), F.expr("transform(own, x -> x.best)").alias("best"))
    docs = aligned.where("pairs is null").select("block", F.lit(True).alias("doc"), F.col(key).alias("__key"), *carry, "links")
    rows = docs.unionByName(told, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "doc")
    kept = ["__key", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            at = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            rows, told = [], []
            for i, doc in enumerate(at["doc"].to_pylist()):
                if not doc:
                    counts = at["counts"][i].values.to_numpy(zero_copy_only=False)
                    best = at["best"][i].values.to_numpy(zero_copy_only=False)
                    continue
                links = at["links"][i].values.to_numpy(zero_copy_only=False)
                rows.append(i)
                told.append((len(links), int(np.count_nonzero(best[links])), int(counts[links].sum())))
            taken = pa.array(rows, pa.int32())
            sums = [pa.array(x, pa.int64()) for x in zip(*told)] if told else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(at[c].take(taken) for c in kept), *sums], names=[*kept, "n_links", "n_best", "count_sum"])

    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{shape}, n_links long, n_best long, count_sum long").withColumnRenamed("__key", key)
