"""URL filters: sorted arrays of 64-bit rule digests, memory-mapped and probed by binary search.

A rule is ``host/path``, with what it decides.  It fits the urls of its host and of all
subdomains whose path starts with its path; of the rules that fit, the longest wins, and
of two equally long ones that with the longer host.

Spark sorts the rules by their xxhash64 and packs each range of them into one array of
bounded size: keys, places of the strings, decisions, strings.  A worker maps the array
from an unlinked file, so that its pages can be given back.  What may fit a url is the
string of each host suffix with each prefix of the path that is as long as some rule's;
all of a batch are looked up by one binary search, and every hit is confirmed on the
stored string, so that equal digests of different strings do no harm.

Null urls, and those without ``://``, have an empty host and path and fit no rule.  A url
that fits no rule gets ``otherwise``.  Repeated rows are judged one by one; an empty table
gives no rows.  A rule given twice with different decisions blocks.  Other columns of the
tables are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import Scratch, small_batches

#: So many rules in one array, about; more rules make more arrays.
SHARD = 1_000_000

#: The seed that Spark's xxhash64 starts from.
SEED = 42

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is behind the first ``://``, up to a slash, question mark, hash or the end, with A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, block: Iterable[str] = (), allow: Iterable[str] = ()) -> DataFrame:
    """(rule, verdict) of two short lists; a long one is read as a table of these columns."""
    rows = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    return spark.createDataFrame(rows, "rule string, verdict string")


def _pack(rules: list[bytes], blocks: list[bool]) -> bytes:
    """One array file: sizes, key by key sorted, and what belongs to each key."""
    keys = np.array([xxhash.xxh64_intdigest(r, SEED) for r in rules], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [rules[i] for i in order]
    hosts = np.array([len(s.split(b"/", 1)[0]) for s in strings], dtype=np.int64)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    lengths = np.unique(sizes - hosts)
    head = np.array([len(strings), len(lengths), hosts.max(initial=0)], dtype=np.int64)
    flags = np.array([blocks[i] for i in order], dtype=np.uint8)
    return b"".join([head.tobytes(), lengths.tobytes(), keys[order].tobytes(), ends.tobytes(), flags.tobytes(), *strings])


class DigestArray:
    """A packed array, mapped from a file that has no name and goes with the process."""

    def __init__(self, packed: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            data = np.memmap(f, dtype=np.uint8, mode="r")
        n, m, self.longest_host = (int(x) for x in data[:24].view(np.int64))
        parts = np.cumsum([24, 8 * m, 8 * n, 8 * (n + 1), n])
        self.lengths = data[parts[0] : parts[1]].view(np.int64).tolist()
        self.keys = data[parts[1] : parts[2]].view(np.uint64)
        self.ends = data[parts[2] : parts[3]].view(np.int64)
        self.blocks, self.strings = data[parts[3] : parts[4]], data[parts[4] :]

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """What a rule that fits must be, the longest first."""
        lengths = [n for n in self.lengths if n <= len(path)]
        at, found = max(len(host) - self.longest_host, 0), []
        if at and host[at - 1] != 0x2E:  # the first suffix that is short enough starts behind a dot
            at = host.find(b".", at) + 1 or len(host)
        while at < len(host):
            found += [(len(host) - at + n, len(host) - at, host[at:] + path[:n]) for n in lengths]
            at = host.find(b".", at) + 1 or len(host)
        return [c for _, _, c in sorted(found, reverse=True)]

    def find(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bool] | None]:
        """The longest rule that fits each url and whether it blocks; None if none fits."""
        names, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            own = self.candidates(host, path)
            names += own
            owner += [i] * len(own)
        out: list[tuple[bytes, bool] | None] = [None] * len(hosts)
        wanted = np.fromiter((xxhash.xxh64_intdigest(n, SEED) for n in names), dtype=np.uint64, count=len(names))
        first, last = (np.searchsorted(self.keys, wanted, side) for side in ("left", "right"))
        for c in np.flatnonzero(first < last):
            if out[owner[c]] is None:
                for at in range(first[c], last[c]):  # equal digests
                    if self.strings[self.ends[at] : self.ends[at + 1]].tobytes() == names[c]:
                        out[owner[c]] = names[c], bool(self.blocks[at])
        return out


@lru_cache(maxsize=1)
def _mapped(name: str, packed: bytes) -> DigestArray:
    return DigestArray(packed)


def packed_arrays(rules: DataFrame, shard: int = SHARD) -> Iterator[bytes]:
    """The packed arrays of (rule, verdict) rows, one at a time; rules without a host are left out."""
    host, path = F.translate(F.regexp_extract("rule", "(?s)^[^/]*", 0), _UPPER, _LOWER), F.regexp_extract("rule", "(?s)/.*$", 0)
    told = rules.where(host != "").groupBy(F.concat(host, path).alias("rule")).agg(F.bool_or(F.col("verdict") == "block").alias("block"))
    count = told.count()
    if not count:
        return

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blocks = [], []
        for batch in batches:
            names += [r.encode() for r in batch.column(0).to_pylist()]
            blocks += batch.column(1).to_pylist()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(names, blocks)], pa.binary())], names=["packed"])

    dealt = told.repartitionByRange(-(-count // shard), F.xxhash64("rule"))
    for row in dealt.mapInArrow(pack, "packed binary").toLocalIterator():
        yield bytes(row["packed"])


def judge(scratch: Scratch, pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", otherwise: str = "allow", shard: int = SHARD) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; ``rules`` are (rule, verdict), verdict ``block`` or another word for allow.

    Pages are passed once for each array of ``shard`` rules, without a shuffle; only the
    array of that pass is broadcast.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    kind = pages.schema[key].dataType.simpleString()
    for i, packed in enumerate(packed_arrays(rules, shard)):
        sent, name = pages.sparkSession.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()

        def probe(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            array = _mapped(name, sent.value)
            rank = lambda rule: (len(rule), len(rule.split(b"/", 1)[0]))
            for batch in batches:
                hosts, paths = ([x.encode() for x in batch.column(c).to_pylist()] for c in (1, 2))
                best, verdict = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for i, hit in enumerate(array.find(hosts, paths)):
                    if hit and (best[i] is None or rank(hit[0]) > rank(best[i].encode())):
                        best[i], verdict[i] = hit[0].decode(), "block" if hit[1] else "allow"
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.string()), pa.array(verdict, pa.string())], names=["__key", "host", "path", "rule", "verdict"])

        if i:  # one array at a time is held by the executors
            rows = scratch.keep(rows)
        rows = rows.mapInArrow(probe, f"__key {kind}, host string, path string, rule string, verdict string")
    return rows.withColumnRenamed("__key", key)
