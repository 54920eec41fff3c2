"""Aggregates, single columns and distinct rows over each public function whose columns come out of a generator."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from hushframe.plans.batch import sanitize_batch
from hushframe.plans.guard import evaluate, sanitize
from hushframe.plans.payloads import guard_payloads
from hushframe.plans.records import sanitize_records

NOTES = [("a", "患者张三，电话13812345678"), ("b", "nothing here"), ("c", None)]
PAYLOADS = [(1, "json", '{"name": "张三", "phone": "13812345678"}'), (2, "csv", "name,phone\n李四,13912345678\n"), (3, "text", "nothing")]


def uses(rows, whole):
    """Every way of taking a part of the rows agrees with the rows themselves."""
    rows = rows.select("decision", "released", "decision.verdict") if whole else rows
    told = rows.select("decision.verdict").collect()
    assert rows.count() == len(told)
    verdicts = sorted(r["verdict"] for r in told)
    assert sorted(r["verdict"] for r in rows.select("decision.verdict").distinct().collect()) == sorted(set(verdicts))
    counted = rows.groupBy("decision.verdict").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in counted) == len(told)
    assert rows.groupBy("decision.verdict").count().count() == len(set(verdicts))


@pytest.mark.parametrize("profile", ["research", "external-ai-strict"])
def test_text_routes(spark, profile):
    notes = spark.createDataFrame(NOTES, "id string, text string")
    uses(evaluate(notes, profile=profile), False)
    rows = sanitize(notes, profile=profile)
    uses(rows, False)
    assert rows.groupBy("decision.verdict", "released").count().count() == len({(r["decision"]["verdict"], r["released"]) for r in rows.collect()})


def test_record_routes(spark):
    files = spark.createDataFrame(PAYLOADS, "file_no int, kind string, content string")
    uses(sanitize_records(files), False)
    uses(guard_payloads(files.drop("kind")), False)
    uses(sanitize_batch(files), False)


def test_entry_can_be_counted(spark):
    rows = driver.entry(spark)
    assert rows.count() == len(rows.collect())
