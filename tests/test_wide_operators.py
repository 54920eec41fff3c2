"""Interval joins, term automata, token numbers over runs, SQL table functions, registered operations, canonical cells."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hushframe.functions import tables
from hushframe.operators import scoring, terms, transform
from hushframe.operators.dataset import batch_tokens, canonical, risk
from hushframe.operators.dictionary import dictionary_facts
from hushframe.operators.intervals import inside, overlapping, untouched_by
from hushframe.operators.token_registry import TokenRegistry
from hushframe.plans.guard import sanitize
from hushframe.plans.policy import PROFILES

SPANS = "doc_id string, type string, start int, end int"


def spans(rng, n, far=400):
    out = []
    for _ in range(n):
        a = rng.randrange(far)
        out.append((rng.choice("ab"), rng.choice("XY"), a, a + rng.choice([0, 1, 5, 30, 200])))
    return out


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_joins_against_all_pairs(spark, width):
    rng = random.Random(width)
    a, b = spans(rng, 60), spans(rng, 40)
    left, right = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    meet = lambda x, y: x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3]
    want = sorted((*x, *y[1:]) for x in a for y in b if meet(x, y))
    told = overlapping(left, right, ["doc_id"], width)
    assert sorted(tuple(r) for r in told.select("doc_id", "l_type", "l_start", "l_end", "r_type", "r_start", "r_end").collect()) == want
    real = [x for x in a if x[2] < x[3]]
    got = inside(left.where("start < end"), right, ["doc_id", "type"], width)
    assert sorted(tuple(r) for r in got.collect()) == sorted(x for x in real if any(y[:2] == x[:2] and y[2] <= x[2] and y[3] >= x[3] for y in b))
    assert sorted(tuple(r) for r in untouched_by(left, right, ["doc_id"], width).collect()) == sorted(x for x in a if not any(meet(x, y) for y in b))


@pytest.mark.parametrize("characters", [10, terms.SHARD_CHARACTERS])
def test_terms_against_brute_force(spark, characters):
    listed = ["he", "she", "hers", "字典", "😀x", "aa", ""]
    texts = [("1", "ushers 字典😀x"), ("2", "aaaa"), ("3", None), ("4", ""), ("5", "none")]
    table = spark.createDataFrame([(t,) for t in [*listed, "he", None]], "term string")
    rows = spark.createDataFrame(texts, "key string, text string")
    want = sorted((k, w, i) for k, t in texts for w in listed if w for i in range(len(t or "")) if t.startswith(w, i))
    assert sorted(tuple(r) for r in terms.occurrences(rows, table, key="key", characters=characters).collect()) == want
    assert {r["term"] for r in terms.occurrences(rows, table, each=False, characters=characters).collect()} == {w for _, w, _ in want}
    assert terms.occurrences(rows, table.where("false"), key="key").collect() == []


def test_leaks_of_many_values_without_a_nested_loop(spark):
    values = spark.range(100_000).selectExpr("concat('value', id) AS value")
    log = [json.dumps({"event_id": "value77", "note": "value12 and value999"}), json.dumps({"event_hash": "value78"}), "value1"]
    told = scoring.leaked_values(spark.createDataFrame([(x,) for x in log], "text string"), values)
    assert "NestedLoop" not in told._jdf.queryExecution().executedPlan().toString()
    assert told.first()["n_leaked"] == len({f"value{n}" for n in (12, 1, 999, 9, 99)})


def test_long_dictionaries_find_what_short_ones_do(spark):
    listed = [("青松康复之家", "institution"), ("康复之家", "institution"), ("康复", "department"), ("三病区", "ward"), ("青松", "staff"), ("青松", "institution")]
    texts = ["复诊地点青松康复之家，三病区", "建议转往青松康复之家", "请康复之家", "", None, "康复康复"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    match = terms.dictionary_matcher(spark, listed)
    told = rows.select(match(F.col("text")).alias("a"), F.coalesce(dictionary_facts(F.col("text"), listed), F.array().cast(terms.FACTS)).alias("b")).collect()
    assert [r["a"] for r in told] == [r["b"] for r in told]
    many = [(f"机构{i}号", "institution") for i in range(100_000)]
    found = spark.createDataFrame([("往来于机构99999号，机构7号",)], "text string").select(terms.dictionary_matcher(spark, many)(F.col("text")).alias("f")).first()["f"]
    assert [(f["value"], f["start"]) for f in found] == [("机构99999号", 3), ("机构7号", 12)]


# -- tokens -----------------------------------------------------------------------

FACT = "file_no int, op_no int, start int, type string, value string"


def test_runs_in_sequence_number_as_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f, rng.randrange(2), rng.randrange(90), rng.choice(["PHONE", "NAME"]), f"v{rng.randrange(30)}") for f in range(12) for _ in range(8)]
    facts = spark.createDataFrame(rows, FACT)
    whole = {(r["type"], r["value"]): r["number"] for r in batch_tokens(facts).collect()}
    registry, told = TokenRegistry(str(tmp_path / "numbers")), {}
    for run, part in enumerate(["file_no < 4", "file_no between 4 and 8", "file_no > 8"]):
        for _ in range(2):  # a run that is repeated tells the same
            told |= {(r["type"], r["value"]): r["number"] for r in registry.assign(facts.where(part), run).collect()}
    assert told == whole
    again = {(r["type"], r["value"]): r["token"] for r in registry.assign(facts, 3).collect()}
    assert all(token == f"[{kind}_{whole[kind, value]:03d}]" for (kind, value), token in again.items())
    assert registry.assign(facts.where("false"), 4).collect() == [] and registry.conflicts(spark).collect() == []


def test_one_large_file_is_numbered_in_several_ranges(spark):
    facts = spark.range(2000).selectExpr("cast(1 as int) AS file_no", "cast(0 as int) AS op_no", "cast(id as int) AS start", "'PHONE' AS type", "concat('v', id) AS value")
    told = batch_tokens(facts)
    assert {r["value"]: r["number"] for r in told.collect()} == {f"v{i}": i + 1 for i in range(2000)}


# -- SQL ----------------------------------------------------------------------------


def test_table_functions(spark):
    tables.register(spark)
    payloads = [(1, "json", '{"name": "张三", "n": 4}'), (2, "csv", "name,phone\n李四,1\n"), (3, "json", "{"), (4, "fhir", "{}")]
    spark.createDataFrame(payloads, "id int, kind string, content string").createOrReplaceTempView("payloads")
    told = spark.sql("SELECT p.id, x.path, x.text, x.start, x.problem FROM payloads p, LATERAL hf_leaves(p.kind, p.content) AS x ORDER BY p.id, x.ord").collect()
    assert [tuple(r) for r in told[:2]] == [(1, "/name", "张三", 0, None), (1, "/n", "4", 3, None)]
    assert [(r["id"], r["text"]) for r in told if r["id"] == 2] == [(2, "李四"), (2, "1")]
    assert {r["id"]: r["problem"] for r in told if r["problem"]} == {3: "PARSER_FAILURE", 4: "UNSUPPORTED_FORMAT"}
    rows = [("a", "X", 0, 5, 0.5), ("a", "Y", 3, 9, 0.9), ("a", "Z", 9, 10, 0.1), ("b", "MEDICAL_CONTENT", 0, 4, 1.0), ("b", "X", 1, 2, 0.1)]
    spark.createDataFrame(rows, SPANS + ", confidence double").createOrReplaceTempView("found")
    merged = spark.sql("SELECT doc_id, type FROM hf_merge_spans(TABLE(found) PARTITION BY doc_id ORDER BY (start, `end` DESC))").collect()
    assert sorted(tuple(r) for r in merged) == [("a", "Y"), ("a", "Z"), ("b", "X")]


# -- operations -----------------------------------------------------------------------


def profile_with(action):
    import dataclasses

    base = PROFILES["research"]
    return dataclasses.replace(base, identifiers={**base.identifiers, "PHONE": (action, 20)})


@pytest.mark.parametrize("sound", [True, False])
def test_a_custom_operation_is_released_only_if_its_check_holds(spark, sound):
    last = lambda v: F.concat(F.lit("<phone *"), F.substring(v, -2, 2), F.lit(">"))
    transform.register(transform.Operation("KEEP_LAST", lambda f, n, d: last(f["value"]), lambda e, d: (e["replacement"] == last(e["value"])) & F.lit(sound), erases=True))
    try:
        with pytest.raises(ValueError, match="there already"):
            transform.register(transform.OPERATIONS["KEEP_LAST"])
        row = sanitize(spark.createDataFrame([("联系电话 13812345678 已核对",)], "text string"), profile=profile_with("KEEP_LAST"), purpose="RESEARCH").first()
    finally:
        transform.unregister("KEEP_LAST")
    assert row["decision"]["verdict"] == "SANITIZE" and row["released"] == sound
    assert row["sanitized"] == ("联系电话 <phone *78> 已核对" if sound else None)
    assert row["verification"]["details"] == (None if sound else "a replacement is wrong")


def test_unknown_operations_are_refused(spark):
    with pytest.raises(ValueError, match="action or risk"):
        profile_with("KEEP_LAST")
    with pytest.raises(ValueError, match="built in"):
        transform.unregister("MASK")


# -- cells ----------------------------------------------------------------------------


def test_numbers_read_as_json_writes_them(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 40.0, 1e16, 1e15, 123456789012345680.0, 1e-7, 1e-4, 9.9e-5, 0.1, 1 / 3, -2.5, 1e300, 12345.678, 1e22, 9007199254740993.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 25) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    told = [r["t"] for r in df.select(canonical(F.col("x"), df.schema["x"].dataType)["text"].alias("t")).collect()]
    assert told == [json.dumps(v) for v in values]


def test_cells_that_are_none(spark):
    df = spark.createDataFrame([(float("nan"), [1], None)], "x double, y array<int>, z double")
    with pytest.raises(Exception, match="no finite number"):
        risk(df, ["x"]).collect()
    with pytest.raises(ValueError, match="single values"):
        risk(df, ["y"])
    assert risk(df, ["z"]).first()["row_count"] == 1
    mixed = spark.createDataFrame([("1e+16", 1e16), ("40", 40.0), ("", None)], "a string, b double")
    both = mixed.select(canonical(F.col("a"), mixed.schema["a"].dataType).alias("k")).unionByName(mixed.select(canonical(F.col("b"), mixed.schema["b"].dataType).alias("k")))
    assert both.groupBy("k").count().count() == 5  # 1e+16 is one; 40 and 40.0, '' and null are two each
