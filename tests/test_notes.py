"""Generated notes, edit scripts and the variants of labelled notes."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.functions.edits import apply, edit, inverse, move_spans, script
from hushframe.operators import mutate
from hushframe.sources import notes


def rows_of(df):
    return sorted(df.collect(), key=repr)


def test_notes_do_not_depend_on_partitions_or_on_each_other(spark):
    few = notes.with_notes(spark.range(40).repartition(1), "id")
    many = notes.with_notes(spark.range(120).repartition(7), "id")
    assert rows_of(few) == rows_of(many.where("doc_id < 40"))
    assert rows_of(few) != rows_of(notes.with_notes(spark.range(40), "id", seed=1))


def test_labels_hold_what_stands_there(spark):
    rows = notes.corpus(spark, 300).collect()
    for r in rows:
        assert all(r["text"][s["start"] : s["end"]] == s["value"] for s in r["spans"])
        found = {s["type"] for s in r["spans"]} - {"MEDICAL_CONTENT"}
        assert r["expected_verdict"] == ("ALLOW" if not found else "ASK" if "RARE_CONTEXT" in found else "SANITIZE")
        assert (r["corpus_role"] == "negative") <= (not found)
    assert {r["document_type"] for r in rows} == set(notes.TYPES)


def test_every_line_and_kind_is_used():
    used = {value for lines in notes.SECTIONS.values() for line in lines for _, value, slot in notes.parts_of(line) if slot}
    assert used | {"number", "dose", "medical"} == set(notes.KINDS)
    assert len({len(x) for x in notes.LAYOUT.values()}) == 1 and {s for x in notes.LAYOUT.values() for s in x} == set(notes.SECTIONS)


def test_notes_of_odd_keys(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "y"), ("a", "y")], "key string, text string")
    rows = notes.with_notes(df, "key").collect()
    assert len(rows) == 3 and len({r["text"] for r in rows}) == 2
    assert notes.with_notes(df.where("false"), "key").count() == 0


def test_corpus_is_written_once(spark, tmp_path):
    made = notes.corpus(spark, 20)
    notes.write_corpus(made, str(tmp_path / "c"))
    assert rows_of(notes.read_corpus(spark, str(tmp_path / "c")).select("text")) == rows_of(made.select("text"))
    with pytest.raises(Exception, match="exists"):
        notes.write_corpus(made, str(tmp_path / "c"))


# -- edit scripts -----------------------------------------------------------------


def test_scripts_against_brute_force(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(60):
        text = "".join(rng.choice("ab😀字 ") for _ in range(rng.randint(0, 12)))
        places = sorted(rng.sample(range(len(text) + 1), rng.randint(0, min(4, len(text) + 1)) // 2 * 2))
        edits = [(a, b, "".join(rng.choice("xy字") for _ in range(rng.randint(0, 3)))) for a, b in zip(places[::2], places[1::2])]
        cases.append((text, edits))
    df = spark.createDataFrame(cases, "text string, e array<struct<start:int,end:int,text:string>>")
    df = df.withColumn("after", apply(F.col("text"), F.col("e")))
    df = df.withColumn("back", apply(F.col("after"), inverse(F.col("text"), F.col("e"))))
    for r in df.collect():
        want, at = "", 0
        for a, b, t in r["e"]:
            want, at = want + r["text"][at:a] + t, b
        assert r["after"] == want + r["text"][at:] and r["back"] == r["text"]


def test_spans_move_with_the_text(spark):
    df = spark.createDataFrame([("ab:CD,ef",)], "text string")
    spans = F.array(F.struct(F.lit("X").alias("type"), F.lit(3).alias("start"), F.lit(5).alias("end")))
    moved = {}
    for name, e in {"before": (0, 2, "xyz"), "at start": (3, 3, "=="), "inside": (4, 4, " "), "whole": (3, 5, "Q"), "at end": (5, 5, "!"), "behind": (6, 8, "")}.items():
        one = script(edit(F.lit(e[0]), F.lit(e[1]), e[2]))
        got = df.select(move_spans(spans, one, apply(F.col("text"), one)).alias("s")).first()["s"][0]
        moved[name] = (got["start"], got["end"], got["value"])
    assert moved == {"before": (4, 6, "CD"), "at start": (5, 7, "CD"), "inside": (3, 6, "C D"), "whole": (3, 4, "Q"), "at end": (3, 5, "CD"), "behind": (3, 5, "CD")}


# -- variants ----------------------------------------------------------------------

SEED = "doc_id string, text string, labels array<struct<type:string,start:int,end:int>>, clean array<string>, verdict string"


def seed(name, text, labels=(), clean=(), verdict="SANITIZE"):
    return name, text, [(t, text.index(v), text.index(v) + len(v)) for t, v in labels], list(clean), verdict


def test_what_cannot_be_judged_is_refused(spark):
    rows = [
        seed("twice", "电话13812345678，13812345678", [("PHONE", "13812345678")]),
        seed("grows", "王五，另见电话 1", [("PERSON_NAME", "王五")]),
        seed("overlap", "患者张伟来诊", [("PERSON_NAME", "张伟")], ["张伟"]),
        ("null", None, None, None, None),
    ]
    told = {}
    for r in mutate.variants(spark.createDataFrame(rows, SEED)).collect():
        told.setdefault(r["mutated_from"], set()).add((r["operator"], r["refused"]))
    assert {why for _, why in told["twice"]} == {"seed"}
    assert "splice_second_patient" not in {op for op, _ in told["grows"]}
    assert {why for _, why in told["overlap"]} == {"overlap"}
    assert told["null"] == {("splice_filler", None)}


def test_variants_by_name_and_without_mutations(spark):
    df = spark.createDataFrame([(*seed("s", "电话：13812345678", [("PHONE", "13812345678")]), None), (*seed("m", "电话：13912345678", [("PHONE", "13912345678")]), "s")], SEED + ", mutated_from string")
    found = mutate.variants(df, ["phone_regroup"], exclude_mutated=True).collect()
    assert [(r["doc_id"], r["text"]) for r in found] == [("s__phone_regroup_1", "电话：138 1234 5678"), ("s__phone_regroup_2", "电话：138-1234-5678")]
    assert mutate.variants(df.where("false")).collect() == []


def test_ages_are_spelled_as_they_are_read():
    words = mutate.spelled()
    assert (words["2"], words["10"], words["20"], words["32"], words["99"]) == ("两", "十", "两十", "三十两", "九十九")
    assert all(mutate.numerals()[w] == n for n, w in words.items())
