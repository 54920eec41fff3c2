"""Benchmark passages against every window of every document."""

import random
from collections import Counter

import pytest

from hushframe.llm import decontaminate
from hushframe.llm.common import Scratch

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture()
def scratch(spark):
    out = Scratch(spark)
    yield out
    out.drop()


def similarity(window, item, k):
    a, b = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (window, item))
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a else 0.0


def leaked(words, item):
    k, n = min(5, len(item)), min(len(words), len(item))
    if len(words) < k:
        return False
    return any(similarity(words[i : i + n], item, k) * 100 >= 80 - 1e-9 for i in range(len(words) - n + 1))


def test_leaks_against_every_window(spark, scratch):
    rng = random.Random(11)
    items = [[rng.choice(WORDS) for _ in range(n)] for n in (3, 12, 25, 40, 80) for _ in range(4)]
    docs = []
    for _ in range(140):
        item = rng.choice(items)
        part = list(item)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(part))
            change = rng.random()
            if change < 0.5:
                part[at] = rng.choice(WORDS)
            elif change < 0.75:
                part.insert(at, rng.choice(WORDS))
            elif len(part) > 1:
                del part[at]
        docs.append([rng.choice(WORDS) for _ in range(rng.choice([0, 0, 3, 30]))] + part + [rng.choice(WORDS) for _ in range(rng.choice([0, 0, 5, 30]))])
    docs += [items[8][:-1], items[8][1:], items[8][:20], items[12][5:]]
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(scratch, rows, table).collect()}
    want = {(i, j) for i, d in enumerate(docs) for j, x in enumerate(items) if leaked(d, x)}
    assert found <= want and len(found) >= 0.99 * len(want) and len(want) > 60  # what the radius loses, if any
    assert {(140, 8), (141, 8)} <= found


def test_rows_without_a_key_and_rows_that_share_one(spark, scratch):
    leak = " ".join(WORDS[:30])
    rows = spark.createDataFrame([(None, f"a {leak} b"), (None, "clean text of its own"), (2, f"x {leak}"), (2, "another clean text"), (2, f"x {leak}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    found = [(r["doc_id"], r["start_word"]) for r in decontaminate.leaks(scratch, rows, items).collect()]
    assert sorted(found, key=repr) == [(2, 1), (None, 1)]


def test_pipeline_drops_leaks_row_by_row(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    leak = " ".join(WORDS[:30])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"a {leak} b"), (None, "clean text"), (2, f"x {leak}"), (2, "another clean text"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(None, "clean text"), (2, "another clean text"), (3, None)], key=repr)
