"""Plans that hold at larger tables: texts are made once, few splits become many tasks, rows pass without a join of their own."""

import re

import __spark_entry__ as driver
from hushframe.sources import notes
from hushframe.streaming.requests import guard_lines

SMALLEST = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def filters(df):
    """What each filter of the plan asks for, with the lines that it goes on over."""
    return re.findall(r"(?ms)^[ :|+-]*Filter (.*?)(?=^[ :|+-]*(?:Project|Filter|Generate|Relation|LogicalRDD|Range|Join|Aggregate|Window|Repartition|Sort|MapIn)|\Z)", plan_of(df))


def test_a_note_is_made_once_for_its_labels(spark):
    made = notes.labels(notes.with_notes(spark.range(40), "id"))
    assert "md5(" in plan_of(made) and not any("md5(" in f for f in filters(made))
    assert "Repartition" in plan_of(driver.queries()["generated_labels"](spark, SMALLEST))


def test_both_sides_of_the_rates_are_spread(spark):
    made = driver.queries()["generated_rates"](spark, SMALLEST)
    assert plan_of(made).count("Repartition") == 2 and not any("md5(" in f for f in filters(made))


def test_approved_records_are_spread(spark):
    assert "Repartition" in plan_of(driver.queries()["granted_json"](spark, SMALLEST))


def test_variants_are_made_once_and_from_spread_seeds(spark):
    made = driver.queries()["mutation_recall"](spark, SMALLEST)
    assert not any("__seed" in f for f in filters(made))
    lines = plan_of(made).splitlines()
    seeds, split = (next(i for i, x in enumerate(lines) if w in x) for w in ("Repartition", "inline(array(struct(operator"))
    assert seeds > split  # the lower line runs first


def test_request_lines_keep_their_keys(spark):
    lines = ["[{\"method\":\"tools/call\"}]", '{"id":1,"method":"tools/call","params":{"arguments":{"q":"a@b.example.com"}}}']
    rows = spark.createDataFrame([(i, lines[i % 2], f"k{i}") for i in range(6)], "step int, line string, `odd name` string")
    told = {r["step"]: (r["line"], r["odd name"], r["action"]) for r in guard_lines(rows).collect()}
    assert told == {i: (lines[i % 2], f"k{i}", ("refuse", "rewrite")[i % 2]) for i in range(6)}
    plan = plan_of(driver.queries()["request_lines"](spark, SMALLEST))
    assert not re.search(r"(?m)^[ :|+-]*(Join|Aggregate)", plan) and plan.count("Relation") == 1
