"""Conversation repair, token alignment and URL filters against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from hushframe.llm import align, repair, urls
from hushframe.llm import queries as q
from hushframe.llm.common import Scratch


@pytest.fixture()
def scratch(spark):
    out = Scratch(spark)
    yield out
    out.drop()


@pytest.fixture()
def many_ranges(spark):
    """Small tables, too, are sorted into several ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


# -- conversation repair ------------------------------------------------------

SOLID = re.compile("[^\x20\x09-\x0d]")
ROLES = ("user", "assistant")


def cheapest(rows):
    """(cost, audit, repaired rows) by trying, row by row, the best way into each state; rows are (role, text, must go, truncated)."""
    behind = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for role in ROLES:
                    then = behind[state].get(role[0])
                    new = (cost + 2, audit + "I", [*out, (role, "")])
                    if then and (then not in best or new[:2] < best[then][:2]):
                        best[then] = new
        return best

    best = {"": (0, "", [])}
    for role, text, gone, late in rows:
        new = {}

        def offer(state, way, new=new):
            if state is not None and (state not in new or way[:2] < new[state][:2]):
                new[state] = way

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", out))
            if not gone:
                offer(behind[state].get(role[:1]), (cost + late, audit + "K", [*out, (role, text)]))
                for r in ROLES:
                    offer(behind[state].get(r[0]), (cost + 2 + late, audit + "R", [*out, (r, text)]))
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])


def expected(table):
    """The contract, conversation by conversation."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), Counter()
        told = []
        for _, role, text in rows:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            told.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = cheapest(told)
        body = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def conversations():
    rng = np.random.default_rng(3)
    words = ["Yes.", "no", "Why?", " ", "", "ok!", "Go on. ", "ümlaut…"]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    table = []
    for conv in [*range(60), None]:
        for turn in range(int(rng.integers(1, 14))):
            t = None if rng.random() < 0.05 else int(turn * rng.integers(1, 3))
            role = ROLES[turn % 2] if rng.random() < 0.7 else roles[rng.integers(len(roles))]
            text = None if rng.random() < 0.04 else words[rng.integers(len(words))] if rng.random() < 0.4 else f"turn {turn} of {conv}."
            table += [(conv, t, role, text)] * (2 if rng.random() < 0.05 else 1)
    table += [(1000, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(700)]
    table += [(1001, 7, "user", "the same.")] * 700 + [(1002, t, "user", "again") for t in range(120)]
    return table


def repaired(spark, scratch, table):
    # columns beyond the four, with names that the operator uses itself
    rows = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, seg int, audit string")
    rows = repair.damaged(rows)
    told, edits = repair.repair(scratch, rows)
    return {r["conv"]: tuple(r)[1:] for r in repair.summary(scratch, rows, told, edits).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair_against_brute_force(spark, scratch):
    table = conversations()
    assert repaired(spark, scratch, table) == expected(table)


def test_conversations_over_several_ranges(spark, scratch, many_ranges):
    table = conversations()
    found = repaired(spark, scratch, table)
    assert found == expected(table)
    rows = repair.ordered(scratch, repair.damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
    assert rows.where("conv = 1000").select("seg").distinct().count() > 1
    assert rows.where("conv = 1001").select("seg").distinct().count() > 1  # equal rows


def test_repair_of_no_rows(spark, scratch):
    assert repaired(spark, scratch, []) == {}
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, scratch, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_a_run_costs_what_its_rows_cost():
    end = repair.END
    for row in range(9):
        for n in (1, 2, 3, 7, 8, 21):
            step = end
            for _ in range(n):
                step = np.minimum((repair.power(row, 0) + step[None, :]).min(axis=1), repair.NEVER)
            assert (repair.costs(row, n, end)[0] == step).all()
            assert ((repair.run_matrix(row, n) + end[None, :]).min(axis=1) == step).all()


# -- token alignment ----------------------------------------------------------

TEXTS = ["the quick brown fox", "", None, "été naïve 😀 日本語 text", "a ▁ mark", "<|endoftext|> <s> </s>", "  two  spaces\n\ttabs\x00nul", "x" * 3000, "the quick brown fox", "word " * 900, "🏳️‍🌈 combining é"]


def aligned_by_hand(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from hushframe.llm.bpe import byte_letters

    byte = {c: i for i, c in enumerate(byte_letters())}
    rows, count = [], Counter()
    for text in texts:
        a = [] if not text else a_of.encode(" " + text, add_special_tokens=False).ids
        b = [] if not text else b_of.encode(text)
        pieces = [bytes(byte[c] for c in a_of.id_to_token(i)) for i in a], [bytes([int(p[1:-1], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_of.id_to_piece(i)]]
        if any(b"".join(p) != (" " + (text or "")).encode() for p in pieces):
            a, b, pieces = [], [], ([], [])
        ends = [list(itertools.accumulate(map(len, p))) for p in pieces]
        spans = [list(zip([0, *e], e)) for e in ends]
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if s < f and t < e]
        cuts, at, groups = sorted(set(ends[0]) & set(ends[1])), 0, []
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, own) if at < e <= cut) for ids, own in zip((a, b), spans)))
            at = cut
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(na, nb, ng, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)) for na, nb, ng, links, g in rows]


def test_alignment_against_brute_force(spark, scratch):
    want = aligned_by_hand(TEXTS)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, block int, pairs string").repartition(3)
    kept = scratch.keep(align.align(docs, q.vocabulary(), q.vocabulary("piece_bpe_32k.model")))
    found = sorted(tuple(r) for r in align.scored(scratch, kept).select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum").collect())
    assert found == [(i, *w) for i, w in enumerate(want)]
    assert want[2] == want[4] == (0, 0, 0, "", 0, 0, 0) and want[5][0] > 0


def test_alignment_of_odd_keys_and_no_rows(spark, scratch):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    kept = scratch.keep(align.align(docs, q.vocabulary(), q.vocabulary("piece_bpe_32k.model")))
    rows = align.scored(scratch, kept).collect()
    assert len(rows) == 4 and {r["count_sum"] for r in rows} == {0, 6}  # two links, each three times in the corpus
    none = scratch.keep(align.align(docs.where("false"), q.vocabulary(), q.vocabulary("piece_bpe_32k.model")))
    assert align.scored(scratch, none).collect() == []


@pytest.mark.parametrize("lane", [1, 3, 1000])
def test_lanes_do_not_matter(lane):
    rng = np.random.default_rng(5)
    a, b = [], []
    starts = [0]
    for size in (0, 50, 1, 400):  # bytes of the documents
        for out in (a, b):
            left = size
            while left:
                out.append(min(left, int(rng.integers(1, 6))))
                left -= out[-1]
        starts.append(len(a))
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    merged = align.lockstep(a_end, b_end, np.array(starts), lane)
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if a_end[i] - a[i] < b_end[j] and b_end[j] - b[j] < a_end[i]]
    assert list(zip(merged.a.tolist(), merged.b.tolist())) == want
    assert merged.a_last.tolist() == [e in set(b_end) for e in a_end.tolist()]


# -- URL filters --------------------------------------------------------------

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("Bad.org", "block"), ("bad.org/ok", "allow"), ("twice.io/", "allow"), ("twice.io/", "block"), ("/nohost", "block")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://m.example.com/en/", "https://example.com/EN/", "x://a.net/es/1", "x://net/fr", "x://net/fr/?q", "x://com", "x://com/", "x://com.", "x://notcom/", "a://b://c.com/", "x://u@h.com:80/", "x://sub.bad.org?x", "x://bad.org/okay", "x://bad.org#f", "x://twice.io/a", "x://y\n.com/\n", "x://" + "a." * 3000 + "com/", "x://É.com/é"]


def judged(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best, verdict = None, "allow"
    merged = {}
    for rule, told in RULES:
        h, slash, p = rule.partition("/")
        if h:
            key = h.lower() + slash + p
            merged[key] = "block" if "block" in (told, merged.get(key)) else told
    for rule, told in merged.items():
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or (len(rule), len(h)) > (len(best), len(best.split("/")[0]))):
            best, verdict = rule, told
    return host, path, best, verdict


@pytest.mark.parametrize("shard", [3, 1_000_000])
def test_urls_against_brute_force(spark, scratch, shard):
    rules = spark.createDataFrame([(*r, 1) for r in RULES], "rule string, verdict string, host int")
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    found = sorted(tuple(r) for r in urls.judge(scratch, pages, rules, shard=shard).collect())
    assert found == [(i, *judged(u)) for i, u in enumerate(URLS)]


def test_urls_without_rules_or_pages(spark, scratch):
    pages = spark.createDataFrame([(None, "x://a.com/"), (None, "x://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(scratch, pages, urls.rule_table(spark), otherwise="block").collect()] == [(None, "a.com", "/", None, "block")] * 2
    assert urls.judge(scratch, pages.where("false"), urls.rule_table(spark, ["com"])).collect() == []


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda data, seed=0: len(data) % 3)
    names = [b"a.com/", b"b.com/", b"c.org/x/", b"org/"]
    array = urls.DigestArray(urls._pack(names, [True, False, True, False]))
    assert array.find([b"b.com", b"d.com", b"z.c.org", b"c.org"], [b"/", b"/", b"/x/y", b"/y"]) == [(b"b.com/", False), None, (b"c.org/x/", True), (b"org/", False)]


# -- licences ---------------------------------------------------------------------


def test_licence_files_are_told_by_their_lines(spark):
    from hushframe.llm import licenses

    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    prose = "\n".join(f"a line of prose about nothing in particular number {i}" for i in range(40))
    rows = [("/r/LICENSE", f"{mit}\n\n{mit}\nCopyright of the authors of this work"), ("/r/a/readme", f"{prose}\n{apache}"), ("/r/a/b/x", prose), ("/r/a/b/NOTICE", apache), ("/r/a/b/c/y", None), ("/q/z", prose), ("/r/long", "\n".join([apache] * 300))]
    found = {r["path"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string"), license_file=None).collect()}
    assert found == {
        "/r/LICENSE": ("MIT", "license_file", None), "/r/a/readme": ("Apache-2.0", "header", None), "/r/a/b/x": ("Apache-2.0", "inherited", "/r/a/b"), "/r/a/b/NOTICE": ("Apache-2.0", "license_file", None),
        "/r/a/b/c/y": ("Apache-2.0", "inherited", "/r/a/b"), "/q/z": (None, "none", None), "/r/long": ("Apache-2.0", "license_file", None),
    }
