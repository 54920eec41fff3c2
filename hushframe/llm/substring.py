"""Removal of word sequences that occur more than once in a corpus.

Every word that lies in a window of ``window`` consecutive words of one document
which also starts anywhere else, in the same document or another one, goes.
Windows are judged on the input.

1. Each window elects as its anchor the ANCHOR-gram with the smallest hash in it
   (the first one of equals).  Equal windows elect equal anchors, so that only
   windows with equal anchors need comparing.  Windows with the same anchor form
   a run; the words that a run covers are its segment.
2. An anchor that occurs once has no repeated window.  An anchor whose segments
   are all equal repeats all its windows.  Both follow from counts and minima.
3. Other anchors form the reference shards: one suffix automaton over the
   distinct segments of an anchor, with their numbers of copies.  Each segment is
   streamed through it for its matching statistic, the longest match ending at
   each word that occurs twice or more; where that reaches the window, the window
   goes.  An anchor with more than ``SHARD_SEGMENTS`` distinct segments, too many
   for one task, is settled by counting its windows' hashes instead, pre-aggregated.
4. The covered spans of a document are merged and its text is cut once.

Shards are sent where their anchor is, not broadcast: the shards of a corpus
grow with it, and to stream every document past all of them is quadratic.

Null and empty texts have no words; texts of fewer words than the window keep
all.  Rows with equal documents repeat each other.  Keys should be distinct;
rows that share a key are each cut by the spans of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Batch, Scratch, _powers, mix, rolling_hashes, small_batches, window_hashes

WINDOW = 35
#: Words of an anchor.
ANCHOR = 8
#: Distinct segments of one anchor that one automaton takes.
SHARD_SEGMENTS = 2_000


class SuffixAutomaton:
    """Of several word sequences, each with a number of copies."""

    def __init__(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _clone(self, p: int, word: int, q: int) -> int:
        c = len(self.go)
        self.go.append(self.go[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link[q] = c
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[int], copies: int) -> None:
        go, link, length, count = self.go, self.link, self.length, self.count
        last = 0
        for word in words:
            q = go[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, word, q)
            else:
                new = len(go)
                go.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0 and word not in go[p]:
                    go[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = go[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
                last = new
            count[last] += copies

    def settle(self) -> None:
        """Give every state the number of places where its words end."""
        link, count = self.link, self.count
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            count[link[s]] += count[s]

    def repeated(self, words: list[int]) -> Iterator[int]:
        """At each word, the length of the longest match that ends there and occurs twice or more."""
        go, link, length, count = self.go, self.link, self.length, self.count
        state = matched = 0
        for word in words:
            while state and word not in go[state]:
                state = link[state]
                matched = length[state]
            if word in go[state]:
                state, matched = go[state][word], matched + 1
            s, n = state, matched
            while s and count[s] < 2:
                s = link[s]
                n = length[s]
            yield n


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``words`` (all documents of a piece in a row), the place of its anchor."""
    size = min(ANCHOR, window)
    grams = window_hashes(words, size)
    span = window - size + 1
    at = np.arange(len(grams))
    have = 1
    while have * 2 <= span:
        left, right = at[: len(at) - have], at[have:]
        at = np.where(grams[right] < grams[left], right, left)
        have *= 2
    if have < span:
        shift = span - have
        left, right = at[: len(at) - shift], at[shift:]
        at = np.where(grams[right] < grams[left], right, left)
    return at


def runs(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor place) of every run; places count from the piece's first word."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(row[:n] == row[window - 1 :])
    at = anchors(words, window)[inside]
    if not len(inside):
        return inside, inside, inside, at
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(inside) != 1))))
    last = np.concatenate((new[1:] - 1, [len(inside) - 1]))
    return row[inside[new]], inside[new], inside[last], at[new]


def segment_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [a, b)."""
    power, inverse = _powers(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])))
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs_of(df: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(key, anchor, seg, i0, i1): the runs of all rows; i0 and i1 are its first and last window."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Batch(batch.column(1))
            for a, b in texts.pieces():
                _, _, _, words, first = texts.words(a, b)
                row, i0, i1, at = runs(words, first, window)
                if not len(row):
                    continue
                grams = window_hashes(words, min(ANCHOR, window))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + a)), _signed(grams[at]), _signed(segment_hashes(words, i0, i1 + window)), pa.array(i0 - first[row], pa.int64()), pa.array(i1 - first[row], pa.int64())],
                    names=[key, "anchor", "seg", "i0", "i1"],
                )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, anchor long, seg long, i0 long, i1 long")


def _words_of(df: DataFrame, wanted: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(anchor, seg, copies, words) of the wanted (key, anchor, seg, copies, i0, i1)."""
    per = wanted.groupBy(key).agg(F.collect_list(F.struct("anchor", "seg", "copies", "i0", "i1")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = Batch(batch.column(0)), batch.column(1)
            for a, b in texts.pieces():
                _, _, _, words, first = texts.words(a, b)
                rows = [(x, first[i]) for i in range(b - a) for x in asked[a + i].as_py()]
                for k in range(0, len(rows), 5_000):
                    part = rows[k : k + 5_000]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x[c] for x, _ in part], pa.int64()) for c in ("anchor", "seg", "copies")), pa.array([words[f + x["i0"] : f + x["i1"] + window].view(np.int64) for x, f in part], pa.list_(pa.int64()))],
                        names=["anchor", "seg", "copies", "words"],
                    )

    return df.select(key, text).join(per, key).select(text, "wanted").mapInArrow(run, "anchor long, seg long, copies long, words array<long>")


def _shards(segments: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, spans) by one automaton per anchor; spans are word places [from, to) in the segment."""

    def settle(group: list[tuple[int, int, int, list[int]]]) -> Iterator[tuple[int, int, list[dict[str, int]]]]:
        machine = SuffixAutomaton()
        for _, _, copies, words in group:
            machine.add(words, copies)
        machine.settle()
        for anchor, seg, _, words in group:
            spans: list[dict[str, int]] = []
            for end, n in enumerate(machine.repeated(words), 1):
                if n >= window:
                    if spans and spans[-1]["b"] >= end - window:
                        spans[-1]["b"] = end
                    else:
                        spans.append({"a": end - window, "b": end})
            if spans:
                yield anchor, seg, spans

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def out(rows: list[tuple[int, int, list[dict[str, int]]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["anchor", "seg", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, list[int]]] = []
        for batch in batches:
            done: list[tuple[int, int, list[dict[str, int]]]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    done += settle(group)
                    group = []
                group.append(row)
            yield out(done)
        if group:
            yield out(list(settle(group)))

    sorted_ = segments.select("anchor", "seg", "copies", "words").repartition("anchor").sortWithinPartitions("anchor")
    return sorted_.mapInArrow(run, "anchor long, seg long, spans array<struct<a:long,b:long>>")


def _counted(segments: DataFrame, window: int) -> DataFrame:
    """As _shards, by counting window hashes: for anchors with too many segments for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, copies, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = rolling_hashes(np.asarray(words, dtype=np.int64).view(np.uint64), window)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x), pa.int64()) for x in (anchor, seg, copies)), _signed(hashes), pa.array(np.arange(n), pa.int64())], names=["anchor", "seg", "copies", "h", "at"])

    windows = segments.select("anchor", "seg", "copies", "words").mapInArrow(run, "anchor long, seg long, copies long, h long, at long")
    often = windows.groupBy("anchor", "h").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    found = windows.select("anchor", "seg", "h", "at").join(often, ["anchor", "h"])
    return found.groupBy("anchor", "seg").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + window).alias("b"))).alias("spans"))


def repeated_spans(scratch: Scratch, df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(key, spans): the word places [a, b) of every row that lie in a repeated window; rows without any are left out."""
    small_batches(df.sparkSession)
    found = scratch.keep(_runs_of(df, key, text, window))
    anchor = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("n > 1")
    # written first: a join right on an aggregate cannot split its hot keys
    anchor = scratch.keep(anchor.select("anchor", (F.col("lo") == F.col("hi")).alias("same")))
    again = scratch.keep(found.join(anchor, "anchor"))
    mixed = again.where("not same")
    distinct = mixed.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct(key, "i0", "i1")).alias("at"))
    distinct = scratch.keep(distinct.select("anchor", "seg", "copies", "at.*"))
    many = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > shard_segments).select("anchor")
    segments = scratch.keep(_words_of(df, distinct, key, text, window).join(many.withColumn("many", F.lit(True)), "anchor", "left"))
    spans = _shards(segments.where("many is null"), window).unionByName(_counted(segments.where("many"), window))
    parts = mixed.join(spans, ["anchor", "seg"]).select(key, F.explode(F.transform("spans", lambda s: F.struct((s["a"] + F.col("i0")).alias("a"), (s["b"] + F.col("i0")).alias("b")))).alias("s"))
    whole = again.where("same").select(key, F.struct(F.col("i0").alias("a"), (F.col("i1") + window).alias("b")).alias("s"))
    return whole.unionByName(parts).groupBy(key).agg(F.collect_list("s").alias("spans"))


def cut(scratch: Scratch, df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; kept has the words that stay, joined by one space."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = Batch(batch.column(1)), batch.column(2)
            for a, b in texts.pieces():
                data, starts, ends, _, first = texts.words(a, b)
                bounds = texts.offsets[a : b + 1] - texts.offsets[a]
                total, gone, kept = [], [], []
                for i in range(b - a):
                    lo, hi = int(first[i]), int(first[i + 1])
                    stay = np.ones(hi - lo, dtype=bool)
                    for s in spans[a + i].as_py() or ():
                        stay[s["a"] : s["b"]] = False
                    total.append(hi - lo)
                    gone.append(int((~stay).sum()))
                    at, end = int(bounds[i]), int(bounds[i + 1])
                    kept.append(_joined(data[at:end], starts[lo:hi][stay] - at, ends[lo:hi][stay] - at).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    spans = repeated_spans(scratch, df, text, key, window)
    return df.select(key, text).join(spans, key, "left").select(key, text, "spans").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words [start, end), joined by one space."""
    if not len(starts):
        return b""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    take = np.cumsum(step[:-1]).astype(bool)
    after = ends[:-1]  # the byte behind each word but the last becomes the space
    out = np.where(take, data, 0x20).astype(np.uint8)
    take[after] = True
    return out[take].tobytes()
