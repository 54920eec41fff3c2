"""The front door: what a payload is, the route it takes, and what may be told about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import strip_invisible, with_fenced
from hushframe.operators.chat import outcome
from hushframe.plans.policy import Profile
from hushframe.plans.records import sanitize_records
from hushframe.sources.admission import is_binary, kind_of

RECORDS = ("json", "csv", "fhir")


def with_payload(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """``df`` with ``kind``: text, json, csv, fhir or unsupported.

    A text is classified, never trusted: JSON read as prose loses the keys that label
    its values.  CSV is only what a caller declares, in the column ``declared``, where
    null asks for classification and an unknown kind is unsupported.  What is classified
    or declared as text loses its invisible characters; unsupported content is null.
    """
    raw = F.col(content)
    plain = strip_invisible(raw)
    kind = kind_of(plain)
    if declared is not None:
        named = F.lower(F.trim(F.col(declared)))
        kind = F.when(F.col(declared).isNull(), kind).when(named.isin("text", *RECORDS), named).otherwise("unsupported")
    kind = F.when(raw.isNull() | is_binary(raw), "unsupported").otherwise(kind)
    rows = with_fenced(df, kind=kind)
    kept = F.when(F.col("kind") == "unsupported", F.lit(None).cast("string"))
    as_is = F.lit(False) if declared is None else F.col(declared).isNotNull() & (F.col("kind") != "text")
    return rows.withColumn(content, kept.when(as_is, raw).otherwise(plain))


def guard_payloads(df: DataFrame, content: str = "content", declared: str | None = None, recipient: str = "EXTERNAL_APPROVED", purpose: str = "EXTERNAL_AI_ASSISTANCE", profile: Profile | str = "external-ai-strict", accepted: Column | None = None) -> DataFrame:
    """``df`` with kind, facts, decision, sanitized, verification and released: each payload by its kind, unreadable content closed.

    One route for all kinds, prose being a record of one leaf: the rows are read once and nothing is shuffled.
    """
    return sanitize_records(with_payload(df, content, declared), "kind", content, recipient, purpose, profile, accepted).drop("leaves", "refusal")


def public_facts(facts: Column) -> Column:
    """Facts without the values that they found."""
    return F.transform(facts, lambda f: f.dropFields("value", "ord"))


def _summary(*more: Column) -> Column:
    d = F.col("decision")
    return F.struct(d["verdict"].alias("verdict"), d["reason_codes"].alias("reason_codes"), d["risk_level"].alias("risk_level"), d["risk_score"].alias("risk_score"), d["policy_version"].alias("policy_version"), *more)


def evaluation_summary() -> Column:
    """What may be told of an evaluated row, as JSON: no value, no text."""
    return F.to_json(_summary(F.size("facts").alias("fact_count")))


def release_summary() -> Column:
    """What may be told of a sanitized row, as JSON; null fields are written."""
    after = (F.col("released") & (F.col("decision.verdict") != "BLOCK")).alias("released")
    return F.to_json(_summary(after, F.col("verification.passed").alias("verification_passed")), {"ignoreNullFields": "false"})


def released_or_fail(text: str = "sanitized") -> Column:
    """The text that may be sent; a row that may not fails the job with the reason and no value, for sinks that must not skip rows."""
    verdict = F.col("decision.verdict")
    approved = (verdict == "ASK") & F.col("decision.plan").isNotNull()
    why = F.when(approved, "verification_failed").otherwise(outcome(verdict, F.col("released")))
    return F.when(F.col("released") & F.col(text).isNotNull(), F.col(text)).otherwise(F.raise_error(why))


def exit_code(rows: DataFrame) -> DataFrame:
    """(exit_code): that of a run over many payloads: 4 if one was blocked or not verified, 3 if one was withheld, else 0."""
    failed = (F.col("decision.verdict") == "BLOCK") | ~F.coalesce(F.col("verification.passed"), F.lit(True))
    code = F.when(failed, 4).when(~F.col("released"), 3).otherwise(0)
    return rows.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def union_of(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one shape; a column that one of them lacks is an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), tables)
