"""Many literal terms in many texts: Aho-Corasick automata of bounded shards, streamed over Arrow batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import lexicon as L
from hushframe.functions.spans import FACTS
from hushframe.operators.dictionary import CATEGORY_TYPES

#: So many characters of terms in one automaton, at most about; longer lists take several passes over the texts.
SHARD_CHARACTERS = 4_000_000

_REFERRAL = tuple(L.REFERRAL.split("|"))


@lru_cache(maxsize=2)
def _automaton(name: str, packed: bytes) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in json.loads(packed):
        out.add_word(term, term)
    if len(out):
        out.make_automaton()
    return out


def _found(automaton: ahocorasick.Automaton, text: str | None) -> Iterator[tuple[int, str]]:
    """(start, term) of every occurrence, overlapping ones included, by end."""
    if text and len(automaton):
        for end, term in automaton.iter(text):
            yield end - len(term) + 1, term


def shards(terms: DataFrame, term: str = "term", characters: int = SHARD_CHARACTERS) -> Iterator[bytes]:
    """The distinct terms in packed lists of bounded size, one at a time."""
    own = terms.select(F.col(term).alias("term")).where("term is not null and term <> ''").distinct()
    total = own.agg(F.sum(F.length("term"))).first()[0] or 0
    if not total:
        return

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [t for batch in batches for t in batch.column(0).to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(held).encode()], pa.binary())], names=["packed"])

    for row in own.repartition(-(-total // characters), "term").mapInArrow(pack, "packed binary").toLocalIterator():
        yield bytes(row["packed"])


def occurrences(texts: DataFrame, terms: DataFrame, text: str = "text", key: str | None = None, term: str = "term", each: bool = True, characters: int = SHARD_CHARACTERS) -> DataFrame:
    """(key, term, start) of every term in every text, places in code points; (term) once for each batch if ``each`` is false.

    One pass over the texts for each shard of terms, without a shuffle; only that shard's
    list is broadcast.  Null texts and empty terms hold and match nothing.
    """
    session = texts.sparkSession
    rows = texts.select(*([F.col(key).alias("key")] if key else [F.lit(0).alias("key")]), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = []
    for packed in shards(terms, term, characters):
        sent, name = session.sparkContext.broadcast(packed), hashlib.sha256(packed).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sent.value)
            for batch in batches:
                hits = ((k, t, s) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, t in _found(automaton, x))
                told = list(hits) if each else [(None, t, None) for t in sorted({t for _, t, _ in hits})]
                cols = list(zip(*told)) if told else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.types[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["key", "term", "start"])

        out.append(rows.mapInArrow(run, f"key {kind}, term string, start int"))
    found = reduce(DataFrame.unionByName, out) if out else rows.where("false").select("key", F.lit("").alias("term"), F.lit(0).alias("start"))
    return found.select(F.col("key").alias(key), "term", "start") if key and each else found if each else found.select("term")


def longest_first(hits: list[tuple[int, str]], text: str) -> list[tuple[int, str]]:
    """Of overlapping hits the first, of those at one place the longest; none right behind a word of referral."""
    out, at = [], 0
    for start, term in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
        if start >= at and not text[:start].endswith(_REFERRAL):
            out.append((start, term))
            at = start + len(term)
    return out


def dictionary_matcher(spark: SparkSession, terms: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A detector of an institution dictionary of any length, for ``extra`` of ``evaluate`` and ``sanitize``.

    ``terms`` are (term, category) as ``dictionary.load`` gives them.  Facts are those of
    ``dictionary.dictionary_facts``, whose alternation tries the terms one by one.
    """
    category: dict[str, str] = {}
    for term, kind in sorted(terms, key=lambda x: (-len(x[0]), x[0], x[1])):
        category.setdefault(term, kind)
    packed = json.dumps(sorted(category)).encode()
    if sum(map(len, category)) > SHARD_CHARACTERS:
        raise ValueError("dictionary: more terms than one automaton holds; use occurrences()")
    sent, name = spark.sparkContext.broadcast((packed, category)), hashlib.sha256(packed).hexdigest()

    @F.pandas_udf("array<struct<start:int,value:string,category:string>>")
    def find(column: pd.Series) -> pd.Series:
        words, kinds = sent.value
        automaton = _automaton(name, words)
        return pd.Series([[{"start": s, "value": t, "category": kinds[t]} for s, t in longest_first(list(_found(automaton, x)), x)] if x else [] for x in column], dtype=object)

    types = F.create_map(*(F.lit(x) for pair in CATEGORY_TYPES.items() for x in pair))

    def fact(s: Column) -> Column:
        return F.struct(
            F.try_element_at(types, s["category"]).alias("type"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).cast("int").alias("end"), F.lit(0.97).alias("confidence"),
            F.concat(F.lit("dictionary."), s["category"]).alias("source"), s["value"].alias("value"), F.lit(False).alias("read_only"), F.lit(1000).alias("ord"),
        )

    return lambda text: F.transform(find(text), fact).cast(FACTS)
