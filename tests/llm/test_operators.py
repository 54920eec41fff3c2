"""The training-data operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import bpe, decontaminate, html_text, language, licenses, lines, minhash, quality, quotes, substring
from hushframe.llm.common import Scratch, connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
FOX = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed five dozen liquor jugs beside a sleepy zebra near the frozen river bank"


@pytest.fixture()
def scratch(spark):
    out = Scratch(spark)
    yield out
    out.drop()


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, node string")


def test_components(spark, scratch):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (9, 8), (8, 7), (7, 6), (1, 1), (6, 9), (20, 3), (None, 4)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(scratch, links).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 20: 3, 6: 6, 7: 6, 8: 6, 9: 6}
    assert connected_components(scratch, links.where("false")).count() == 0


def test_minhash_against_brute_force(spark, scratch):
    base = FOX.split()
    rows = [FOX, FOX.upper(), " ".join(base[:-1]), " ".join(base[2:]), " ".join(base[5:] + base[:5]), "one two", "ONE two", "one", None, "", "  \n ", " ".join(base * 40)]
    sets = []
    for t in rows:
        w = WORD.findall((t or "").lower())
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset())
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(scratch, texts(spark, rows), size=3, percent=85).collect()}
    assert found == {i: (len(s), group[i]) for i, s in enumerate(sets)}


def test_minhash_of_an_empty_table(spark, scratch):
    assert minhash.groups(scratch, texts(spark, ["x"]).where("false")).count() == 0


def test_posterior_bound_is_lenient_at_the_threshold():
    assert minhash.least_matches(0.85, 32) < 0.85 * 32
    assert minhash.least_matches(0.85, 32, 0.5) > minhash.least_matches(0.85, 32, 1e-8)
    assert minhash.bands_for(0.8) > minhash.bands_for(0.9)


def test_html():
    out = html_text.extract("<head><title>t</title></head><p>a <b>b</b><p>c<ul><li>x<ul><li>y<li>z</ul><li>w</ul><table><tr><th>N<th>Val<tr><td>aa<td>1</table><div hidden>no</div><span style='display: none'>h</span>t<br>u<script>q</script>")
    assert out == "a b\n\nc\n\n- x\n  - y\n  - z\n- w\n\nN   Val\naa  1\n\nt\nu"
    assert html_text.extract("") == "" and html_text.extract("<p") == "<p"
    assert html_text.extract("<pre>a\n  b</pre>") == "a\n  b"
    assert html_text.extract("<div>" * 5000 + "deep") == "deep"
    assert html_text.extract("<!-- x <p>y</p>") == "y"


def test_html_cells_over_several_rows():
    table = lambda rows: html_text.extract(f"<table>{rows}</table>").split("\n")
    assert table("<tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e") == ["A  b", "   c", "d  e"]
    assert table("<tr><td>a<td rowspan=0>B<td>c<tr><td>d<td>e<tr><td>f<td>g") == ["a  B  c", "d     e", "f     g"]
    assert table("<tr><td rowspan=2 colspan=2>A<td>x<tr><td>y<tr><td>p<td>q<td>z") == ["A     x", "      y", "p  q  z"]
    assert table("<tr><td rowspan=2>A<tr><tr><td>b<td>c") == ["A", "b  c"]
    assert table("<tr><td rowspan=x>A<td>b<tr><td>c<td rowspan=99999999>d") == ["A  b", "c  d"]


def test_html_of_an_empty_table_repeated_keys_and_odd_columns(spark):
    kind = "page_id long, html string, score int"
    assert html_text.extract_text(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, "<p>x", 1), (1, "<p>y", 2), (None, "<b>z", 3), (2, "", 4), (2, "", 4)]
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract_text(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, "z"), (1, "x"), (1, "y"), (2, ""), (2, "")]
    long = "<table>" + "<tr><td rowspan=2>a<td>b<tr><td>c" * 20_000 + "</table>"
    assert html_text.extract(long).count("\n") == 39_999


def test_html_nulls(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "<p>x", 1)], "page_id long, html string, text int")
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(rows).collect()} == {1: None, 2: "x"}


def test_language(spark):
    en, fr = "the house and the garden were quiet in the evening ", "la maison et le jardin étaient calmes dans la soirée "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "12 34", None), (102, "", "fr"), (103, "the evening was quiet", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where(language.not_held_out()))
    told = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(told[i]["lang_pred"] == lang and 0 <= told[i]["score"] <= 1 for i, _, lang in rows)
    assert [told[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert told[100]["rejected"] and not told[1]["rejected"]
    nothing = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_language_limits_without_evidence(spark):
    en = "the house and the garden were quiet in the evening "
    docs = spark.createDataFrame([*((i, en + f"and number {i}", "en") for i in range(150)), (900, "猫は庭で静かに眠っていた", "ja")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, en * 100), (2, "犬は川の近くで眠らない"), (3, en)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.predict(asked, model).collect()}
    # no learned text is as long as the first, and one knows the second language by heart
    assert found[1] == ("en", False) == found[3] and found[2] == ("ja", False)


def test_language_limits_from_neighbours():
    texts = np.zeros((2, language.CLASSES), np.int64)
    texts[0, [2, 5]], texts[1, 2] = 200, 3
    high = np.full(texts.shape, -np.inf)
    high[0, 2], high[0, 5], high[1, 2] = 2.0, 1.5, 4.0
    assert language.limits_of(high, texts).tolist() == [[np.inf] * 2 + [4.5] * 3 + [2.0] * 4, [np.inf] * language.CLASSES]


def test_quotes(spark, scratch):
    rows = [(1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> hello there\n> how are you?\nFine"), (1, 2, "u", ">> Hello there\n> Fine\ngood"), (1, 3, "u", "Else"), (1, 4, "a", "> How are\n> you?\nanswer"), (2, 0, "u", None), (None, 1, "u", "x")]
    found = quotes.thread(scratch, spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    told = {(r["conv_id"], r["turn"]): (r["reply_to"], r["root_turn"], r["depth"], r["position"], r["text"]) for r in found.collect()}
    assert told == {
        (1, 0): (None, 0, 0, 1, "Hello there\nHow are you?"), (1, 1): (0, 0, 1, 2, "Fine"), (1, 2): (1, 0, 2, 3, "good"), (1, 4): (0, 0, 1, 4, "answer"), (1, 3): (None, 3, 0, 5, "Else"), (2, 0): (None, 0, 0, 1, None),
    }


def test_quality(spark):
    rows = ["a b c a b c " * 30, "fine words stand here one by one\n" * 2, None, "", "### $$$ %% word\nword\nword"]
    found = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(texts(spark, rows))).collect()}
    for i, t in enumerate(rows):
        w = WORD.findall(t or "")
        wins = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for d in range(3)}
        held = [x for x in (t or "").split("\n") if WORD.search(x)]
        got = found[i]
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"], got["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(held) - len(set(held)))
        assert got["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert got["n_symbols"] == len(re.findall("[#*$%&|<>]", t or ""))
    counts = {(r["policy_version"], r["rule"]): r for r in quality.ablation(quality.ledger(texts(spark, rows))).collect()}
    assert counts["base", "few_words"]["n_docs"] == len(rows) and counts["base", "few_words"]["n_failed"] == 4


def test_licenses(spark):
    rows = [("/a/LICENSE", "Released under the MIT License.", True), ("/a/b/x", "nothing", False), ("/a/b/y", "code\nLicensed under the Apache License, Version 2.0.", None), ("/z", None, False), (None, "t", False), ("/a/b/c/d", "", False)]
    found = {r["path"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, license_file boolean")).collect()}
    assert found["/a/LICENSE"][:2] == ("MIT", "license_file") and found["/a/b/y"][:2] == ("Apache-2.0", "header")
    assert found["/a/b/x"] == ("MIT", "inherited", "/a") == found["/a/b/c/d"]
    assert found["/z"][:2] == (None, "none") == found[None][:2]


def test_decontamination(spark, scratch):
    item = FOX
    words = item.split()
    rows = ["start " + item.upper() + " end", " ".join(words[:12] + ["other"] + words[13:]), "a b c", None, "", "tiny item!", " ".join(words[1:] + ["x"])]
    items = spark.createDataFrame([(7, item, 1), (8, "tiny item", 2), (9, None, 3), (10, "", 4)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.leaks(scratch, texts(spark, rows), items).collect()}
    assert found[0, 7] == (1, 1.0) and found[5, 8] == (0, 1.0)
    assert set(found) == {(0, 7), (5, 8), (6, 7)}
    assert decontaminate.leaks(scratch, texts(spark, rows), items.where("false")).count() == 0


def test_lines(spark, scratch):
    long_ = " ".join(f"w{i}" for i in range(60))
    rows = [f"{FOX}\nalpha beta\n\nown line", f"ALPHA, beta!\n{FOX}.\n{long_} end", f"{long_} ends\n---", None, "", "alpha beta"]
    docs = texts(spark, rows)
    gone = lines.dropped_lines(scratch, docs)
    cut = {r["doc_id"]: r["text"] for r in lines.without_lines(docs, gone).collect()}
    assert cut[0] == rows[0] and cut[3] is None and cut[4] == "" and cut[5] == ""
    assert cut[1].split("\n")[0] == f"{long_} end" and len(cut[1].split("\n")) == 1
    assert cut[2] == "---"
    assert lines.without_lines(docs, gone).columns == docs.columns


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_lines_recall_against_brute_force(spark, scratch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows = []
    for n in [2, 3, 4, 5] * 20 + [8, 12, 20, 30] * 15:
        words = [word() for _ in range(n)]
        rows.append(" ".join(words))
        if n <= 5:  # letters changed, put in and taken out, up to a fifth and beyond
            letters = list(rows[-1])
            for _ in range(rng.randint(1, len(letters) // 5 + 1)):
                at = rng.randrange(1, len(letters) - 1)
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            rows.append("".join(letters))
        else:  # one word, or a seventh of the words replaced
            for at in rng.sample(range(n), rng.choice([1, max(n // 7, 1)])):
                words[at] = word()
            rows.append(" ".join(words))
    rows = list(dict.fromkeys(rows))
    links = {(a, b) for a, b in combinations(range(len(rows)), 2) if 5 * abs(len(rows[a]) - len(rows[b])) <= max(len(rows[a]), len(rows[b])) and (b == a + 1 or len(rows[b]) < 33) and 5 * _edits(rows[a], rows[b]) <= max(len(rows[a]), len(rows[b]))}
    told, classes = lines.groups(scratch, texts(spark, rows))
    found = {r["key"]: r["component"] for r in told.join(classes, ["node", "other"]).select("doc.key", "component").collect()}
    hit = {(a, b) for a, b in links if a in found and found[a] == found.get(b)}
    assert len(links) > 60 and not {x for x in links - hit if max(len(rows[x[0]]), len(rows[x[1]])) <= lines.SHORT}
    assert len(hit) >= 0.99 * len(links)
    assert set(found) <= {x for pair in links for x in pair}


def test_lines_lose_no_link_at_any_rate_of_edits(spark, scratch, monkeypatch):
    monkeypatch.setattr(lines, "PART", 40)
    monkeypatch.setattr(lines, "CENTRES", 16)
    rng = random.Random(17)
    rows = []
    for n in (31, 40, 64, 90, 150, 260, 450, 700):
        for rate in (0.05, 0.1, 0.15, 0.2, 0.21):
            letters = [rng.choice("abcdefghij") for _ in range(n)]
            rows.append("".join(letters))
            for at in rng.sample(range(1, n - 1), int(n * rate)):
                letters[at] = rng.choice(["", "x", "yz"])
            rows.append("".join(letters))
        letters = [rng.choice("abcdefghij") for _ in range(n)]
        rows += ["".join(letters), "".join("x" if k % 5 == 4 else c for k, c in enumerate(letters))]  # no five letters in a row are left
    for n in (420, 600):  # more than LONG letters: a fifth of the words, every fifth one
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)]
        rows += [" ".join(words), " ".join("xx" if k % 5 == 4 else w for k, w in enumerate(words))]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if lines.alike([(rows[a], rows[b])])[0]:
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    told, classes = lines.groups(scratch, texts(spark, rows))
    found = {r["key"]: r["component"] for r in told.join(classes, ["node", "other"]).select("doc.key", "component").collect()}
    assert len(rows) - len(set(group)) > 30
    for a, b in combinations(range(len(rows)), 2):
        assert (group[a] == group[b]) == (a in found and found[a] == found.get(b))


def test_edit_distances_side_by_side():
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    pairs = [(some(n), some(max(n + rng.randint(-3, 3), 0))) for n in (0, 1, 2, 5, 63, 64, 65, 130) for _ in range(6)]
    assert lines.distances(pairs).tolist() == [_edits(a, b) for a, b in pairs] == [lines.distance(a, b) for a, b in pairs]


def test_lines_of_odd_rows(spark, scratch):
    long_ = " ".join(f"word{i * 7919 % 1000}" for i in range(20_000))
    rows = [(None, FOX, 1), (1, FOX, 2), (1, FOX, 3), (1, f"other text\n{FOX}", 4), (2, long_, 5), (3, long_.replace("word5 ", "x "), 6), (4, "", 7), (5, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = {r["node"]: r["text"] for r in lines.without_lines(docs, lines.dropped_lines(scratch, docs)).collect()}
    # the null key comes first; rows of one key keep their own lines; a near copy of a very long line goes
    assert out == {1: FOX, 2: "", 3: "", 4: "other text", 5: long_, 6: "", 7: "", 8: None}
    nothing = docs.where("false")
    assert lines.without_lines(nothing, lines.dropped_lines(scratch, nothing)).count() == 0


def test_large_blocks_lose_no_link(spark, scratch, monkeypatch):
    monkeypatch.setattr(lines, "CENTRES", 2)
    monkeypatch.setattr(lines, "PART", 5)
    rng = random.Random(3)
    base = [f"w{i}{'abcdefgh'[i % 8] * 3}" for i in range(30)]
    rows = []
    for _ in range(25):  # each a sixth off the base, so that many pairs are just beyond the threshold
        own = list(base)
        for at in rng.sample(range(5, 30), 5):
            own[at] = f"z{rng.randint(100, 999)}yy"
        rows.append(" ".join(own))
    told, classes = lines.groups(scratch, texts(spark, rows))
    found = {r["key"]: r["component"] for r in told.join(classes, ["node", "other"]).select("doc.key", "component").collect()}
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            if 5 * _edits(rows[a], rows[b]) <= max(len(rows[a]), len(rows[b])):
                group[a] = group[b] = min(group[a], group[b])
    for a, b in combinations(range(len(rows)), 2):
        assert (group[a] == group[b]) == (a in found and found[a] == found.get(b))


def test_simhash_paths_agree(spark):
    words = spark.createDataFrame([(1, i * 7919 * 104729 + 13) for i in range(99)], "node long, h long")
    packed = lines.simhash(words.withColumn("packed", F.lit(True)), "node").first()["fp"]
    assert packed == lines.simhash(words.withColumn("packed", F.lit(False)), "node").first()["fp"]


def test_substrings(spark, scratch):
    words = [f"w{i}" for i in range(80)]
    rows = [" ".join(words), "lead " + " ".join(words[10:60]) + " tail", " ".join(["same"] * 40), None, "", "short text", " ".join(words[:34]), " ".join(words[20:70] + ["z"])]
    count = Counter(tuple(w[i : i + 35]) for w in map(WORD.findall, (t or "" for t in rows)) for i in range(len(w) - 34))
    for limit in (1, 1000):  # counted and by automaton
        spans = substring.repeated_spans(scratch, texts(spark, rows), shard_segments=limit).collect()
        covered = {r["doc_id"]: {k for s in r["spans"] for k in range(s["a"], s["b"])} for r in spans}
        for i, t in enumerate(rows):
            w = WORD.findall(t or "")
            expected = {k + d for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for d in range(35)}
            assert covered.get(i, set()) == expected
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.cut(scratch, texts(spark, rows)).collect()}
    assert kept[1] == (52, 50, "lead tail") and kept[3] == (0, 0, "") and kept[5] == (2, 0, "short text")


def test_bpe(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(P.path("byte_bpe_50k.json"))
    reference = Tokenizer.from_file(path)
    rows = ["Hello world", "a<|endoftext|>b", "  x  \n\n y\t", "don't we'LL 'S", "a" * 1000, "é" * 70 + "ab" * 90, "日本語 😀", "1234567 ¼", "", None]
    found = {r["doc_id"]: r for r in bpe.round_trip(texts(spark, rows), path, with_ids=True).collect()}
    for i, t in enumerate(rows):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert found[i]["ids"] == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(texts(spark, rows), path)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()} == {i: t or "" for i, t in enumerate(rows)}


def test_minhash_of_repeated_and_null_keys(spark, scratch):
    v, w = FOX, " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, w, 0), (1, v, 0), (2, v + " z", 0), (3, w + " z", 0), (None, w, 0), (None, None, 0), (9, "", 0)], "doc_id long, text string, node int")
    found = {r["doc_id"]: r["component_id"] for r in minhash.groups(scratch, rows, size=3, percent=85).collect()}
    assert found == {1: 1, 2: 1, 3: 1, None: 1, 9: 9}


def test_minhash_large_buckets_lose_no_link(spark, scratch, monkeypatch):
    for name, n in (("CENTRES", 2), ("SMALL", 3), ("PART", 5)):
        monkeypatch.setattr(minhash, name, n)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for _ in range(30):
        own = list(base)
        for at in rng.sample(range(100), 2):
            own[at] = f"z{rng.randint(0, 9)}"
        rows.append(" ".join(own))
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in map(str.split, rows)]
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    found = {r["doc_id"]: r["component_id"] for r in minhash.groups(scratch, texts(spark, rows), size=3, percent=85).collect()}
    assert found == dict(enumerate(group))


def test_minhash_small_buckets_give_plausible_pairs_once(spark, scratch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(base), *(" ".join([*base[:k], "x", *base[k:]]) for k in (5, 30, 50)), *(" ".join(rng.sample(base, 60)) for _ in range(20))]
    told = minhash.describe(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string"), "text", "id", 3, 32)
    signs = scratch.keep(told.select(F.col("digest").alias("node"), "n_shingles", "signature", "bands"))
    # buckets of all rows, whatever their bands: only those of like rows may give a pair, and each pair its first one
    own = signs.select("node", F.col("node").alias("component"), F.explode("bands").alias("bucket"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = [(bytes(r["u"]), bytes(r["v"])) for r in minhash._small_pairs(own, signs, 0.85, 1e-8).collect()]
        one = minhash._small_pairs(own.withColumn("component", F.lit(b"0")), signs, 0.85, 1e-8).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    like = {bytes(r["digest"]) for r in told.where("id < 4").collect()}
    assert sorted(found) == [(a, b) for a, b in combinations(sorted(like), 2)] and one == 0


def test_letters_of_all_planes():
    texts_ = ["\U0001f600\U0001f600", "́", "12 \U0001f600 34", "\U00010400", "猫", "é", ""]
    assert language.keys_of(texts_)[2].tolist() == [0, 0, 0, 1, 1, 1, 0]


def test_a_language_that_was_not_learned_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    model = language.fit(docs.where("lang <> 'es'"))
    told = language.predict(docs, model).where("length(text) > 200")
    share = {r["lang"]: r["share"] for r in told.groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert share["es"] > 0.5 and max(v for k, v in share.items() if k != "es") < 0.01


ODD = "doc_id long, text string, score int, n_words int, words string, license string"


def odd_rows(spark, *rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, 1, 2, "w", "l") for k, t in rows], ODD)


def test_empty_tables(spark, scratch):
    none = odd_rows(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.apply_policy(quality.ledger(none)).collect() == substring.cut(scratch, none).collect() == []
    assert decontaminate.leaks(scratch, none, items).collect() == []
    assert decontaminate.leaks(scratch, odd_rows(spark, (1, FOX)), items).collect() == []
    assert quotes.thread(scratch, spark.createDataFrame([], "conv_id int, turn int, role string, text string")).collect() == []
    assert licenses.scan(spark.createDataFrame([], "path string, text string, license_file boolean, score int")).collect() == []


def test_null_and_repeated_keys_beside_odd_columns(spark, scratch):
    rows = odd_rows(spark, (1, FOX), (1, "a b"), (None, "a b c"), (2, None), (2, None), (3, ""))
    measured = Counter((r["doc_id"], r["n_words"]) for r in quality.ledger(rows).collect())
    assert measured == Counter([(1, len(WORD.findall(FOX))), (1, 2), (None, 3), (2, 0), (2, 0), (3, 0)])
    items = spark.createDataFrame([(7, FOX, 0), (8, None, 0), (9, "", 0)], "item_id long, text string, score int")
    found = decontaminate.leaks(scratch, rows, items).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in found] == [(1, 7, 0)]


def test_a_very_long_text(spark, scratch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(150_000)]
    rows = odd_rows(spark, (1, " ".join(words)), (2, " ".join(["x", *words[70_000:70_040], "y"])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.cut(scratch, rows).collect()}
    assert got == {1: (150_000, 40), 2: (42, 40)}
    assert {r["doc_id"]: r["n_words"] for r in quality.ledger(rows).collect()} == {1: 150_000, 2: 42}
    items = spark.createDataFrame([(7, " ".join(words[100_000:100_030]))], "item_id long, text string")
    assert [(r["doc_id"], r["start_word"]) for r in decontaminate.leaks(scratch, rows, items).collect()] == [(1, 100_000)]
