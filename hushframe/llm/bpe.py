"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pre-token's bytes are kept as one array of part boundaries and one array of
the ranks of adjacent part pairs.  The smallest rank is found by a scan, its
right boundary is deleted, and the two neighbouring ranks are refreshed.  That
is quadratic in the pre-token's length, and fastest for short ones; pre-tokens
of more than SHORT bytes take the same merges from a heap of linked parts.

The vocabulary is a file of the ``tokenizers`` library (byte-level BPE, without
normaliser, prefix space, truncation or padding); its path is a parameter and
each Python worker reads it once.  Results of pre-tokens are remembered in a
table of bounded size.

Null texts encode as empty ones.  Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hushframe.llm.common import small_batches

#: Fixed value: how byte-level BPE with 50,257 ids splits a text into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens of at most so many bytes are merged by scanning the rank array.
SHORT = 64

#: So many remembered pre-tokens at most; the table starts anew beyond that.
REMEMBERED = 400_000

#: Bits of a token id beside a merge's rank in one number.
_ID = 20
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Encoder:
    """Encodes and decodes with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.first = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.merges = {pair: rank << _ID | token for pair, (rank, token) in self.pairs.items()}
        self.piece = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pre = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    # one pre-token -----------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        return self._scan(data) if len(data) <= SHORT else self._heap(data)

    def _scan(self, data: bytes) -> list[int]:
        first, merges = self.first, self.merges.get
        ids = [first[b] for b in data]
        ranks = [merges(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            ids[at] = low & ((1 << _ID) - 1)
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges((ids[at], ids[at + 1]), _NONE)
            if at:
                ranks[at - 1] = merges((ids[at - 1], ids[at]), _NONE)
        return ids

    def _heap(self, data: bytes) -> list[int]:
        ids = [self.first[b] for b in data]
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = pairs[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (hit := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (hit[0], a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    # whole texts -------------------------------------------------------

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of the text, and whether each is a special token's string."""
        if self.split_special is None:
            yield text, False
            return
        for i, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, bool(i % 2)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.parts(text):
            if special:
                out.append(self.special[part])
            else:
                out += self.encode_plain(part)
        return out

    def encode_plain(self, text: str) -> list[int]:
        """As encode, with the strings of special tokens as plain text."""
        out: list[int] = []
        known = self.known
        for word in self.pre.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = tuple(self.merge(word.encode()))
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every row's text, by key; other columns are left out."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            found = [tokenizer.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=[key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the text of every row's token ids; a null list is an empty one."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            found = [tokenizer.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{text}` string")


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, encoded and decoded again; and ids, if asked for.

    One pass: the digests are taken where the ids are made, so that neither ids
    nor texts travel further than they must.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            count, of_ids, of_text, lists = [], [], [], []
            for t in batch.column(1):
                ids = tokenizer.encode(t.as_py() or "")
                count.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(tokenizer.decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                ends = pa.array([0, *itertools.accumulate(count)], pa.int32())
                columns, names = [*columns, pa.ListArray.from_arrays(ends, flat)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
