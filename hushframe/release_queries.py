"""Queries of whole releases: routes of payloads, approvals, batches of files, benchmark totals, notes with many facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.rows import settled, spread
from hushframe.operators import audit, grants, scoring
from hushframe.operators.detect import with_facts
from hushframe.plans import batch
from hushframe.plans.approval import approve, asked
from hushframe.plans.guard import evaluate, sanitize
from hushframe.plans.payloads import evaluation_summary, guard_payloads, public_facts, release_summary
from hushframe.plans.records import evaluate_records, sanitize_records
from hushframe.queries import _DOC, _KEY8, _NAME, NOTES, _log, query, table
from hushframe.sources.structured import fhir_path, with_rows

# -- the front door ---------------------------------------------------------------

_ROUTED = f"""CASE c_custkey % 5 WHEN 0 THEN concat(' {{"name": "', {_NAME}, '"}}') WHEN 1 THEN concat('患者：', {_NAME}, '，入院') WHEN 2 THEN concat('姓名,备注', chr(10), {_NAME}, ',ok', chr(10))
  WHEN 3 THEN concat('a', chr(1)) ELSE 'hel​lo' END"""


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'json' WHEN 2 THEN 'csv' WHEN 3 THEN 'unsupported' ELSE 'text' END AS kind, CASE c_custkey % 5 WHEN 3 THEN 'BLOCK' WHEN 4 THEN 'ALLOW' ELSE 'SANITIZE' END AS verdict,
    CASE c_custkey % 5 WHEN 0 THEN concat('{', chr(10), '  "name": "[PERSON_NAME_001]"', chr(10), '}') WHEN 1 THEN '患者：[PERSON_NAME_001]，入院' WHEN 2 THEN concat('姓名,备注', chr(10), '[PERSON_NAME_001],ok', chr(10)) WHEN 4 THEN 'hello' END AS sanitized FROM customer"""
)
def payload_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON told from prose, CSV where it is declared, control characters closed, invisible characters gone."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ROUTED} AS content", "CASE WHEN c_custkey % 5 = 2 THEN 'csv' END AS declared")
    return guard_payloads(spread(rows), declared="declared").select("c_custkey", "kind", F.col("decision.verdict").alias("verdict"), "sanitized")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SANITIZE' ELSE 'ALLOW' END AS verdict, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END AS fact_count, 'true' AS released, CASE WHEN c_custkey % 2 = 0 THEN 'true' END AS verified, false AS leaked FROM customer")
def public_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and facts that hold no value."""
    text = "CASE WHEN c_custkey % 2 = 0 THEN concat('邮箱：u', cast(c_custkey as string), '@mail.example.com') ELSE 'hello' END AS text"
    told = sanitize(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", text))).select("c_custkey", evaluation_summary().alias("e"), release_summary().alias("r"), F.to_json(public_facts(F.col("facts"))).alias("f"))
    get = F.get_json_object
    leaked = F.contains(F.concat("e", "r", "f"), F.lit("@"))
    return told.select("c_custkey", get("e", "$.verdict").alias("verdict"), get("e", "$.fact_count").alias("fact_count"), get("r", "$.released").alias("released"), get("r", "$.verification_passed").alias("verified"), leaked.alias("leaked"))


@query("SELECT c_custkey, concat('Bundle.entry.resource.name.k/', c_custkey, '~') AS path FROM customer")
def fhir_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('/Bundle/entry/', c_custkey, '/resource/name/0/k~1', c_custkey, '~0') AS pointer")
    return rows.select("c_custkey", fhir_path(F.col("pointer")).alias("path"))


# -- approvals -----------------------------------------------------------------------

_RARE = f"concat('患者：', {_NAME}, '，本县唯一，电话 138', {_KEY8}, '。')"


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN '患者：[PERSON_NAME_001]，本县唯一，电话 [REDACTED]。' END AS sanitized, c_custkey % 3 <> 1 AS released FROM customer")
def granted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rare context asks; what was approved is rewritten and verified, the rest withheld."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_RARE} AS text", "CASE c_custkey % 3 WHEN 0 THEN array('PHONE') WHEN 2 THEN cast(array() AS array<string>) END AS accepted")
    return sanitize(rows, accepted=F.col("accepted")).select("c_custkey", "sanitized", "released")


@query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN concat('{{', chr(10), '  "name": "[PERSON_NAME_001]",', chr(10), '  "phone": "[REDACTED]"', chr(10), '}}')
    WHEN c_custkey % 8 = 0 THEN concat('{{', chr(10), '  "name": "[PERSON_NAME_001]",', chr(10), '  "phone": 138', {_KEY8}, chr(10), '}}') END AS sanitized FROM customer"""
)
def granted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone in a number stays where its type is accepted; another accepted type opens nothing."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'json' AS kind", f"{_DOC} AS content", "CASE WHEN c_custkey % 8 = 0 THEN array('PHONE') ELSE array('AGE') END AS accepted")
    return sanitize_records(spread(rows), accepted=F.col("accepted")).select("c_custkey", "sanitized")


@query(
    """SELECT c_custkey, 0::BIGINT AS field_no, c_custkey % 4 = 0 AS accepted, CASE c_custkey % 4 WHEN 1 THEN 'another field of the request is withheld' WHEN 2 THEN 'another field of the request is withheld'
      WHEN 3 THEN 'grant has expired, been revoked, or has already been used' END AS problem FROM customer
    UNION ALL SELECT c_custkey, 1, false, 'no grant' FROM customer WHERE c_custkey % 4 = 1"""
)
def approval_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two fields: all of them are judged before a grant loses a use."""
    second = f"CASE c_custkey % 4 WHEN 1 THEN concat('另', {_RARE}) WHEN 2 THEN concat('a', chr(7)) ELSE 'hello' END"
    fields = table(spark, sf_dir, "customer").selectExpr("c_custkey AS request_id", f"posexplode(array({_RARE}, {second})) AS (field_no, content)")
    rows = settled(asked(evaluate(spread(fields), "content"), b"key").select("request_id", "field_no", "decision", "fingerprint", "untransformable_types"))
    first = rows.where("field_no = 0 and fingerprint is not null").select("request_id", "fingerprint", F.array().cast("array<string>").alias("accepted_types"))
    held = grants.with_validity(grants.issue(first, b"key", "desk", F.expr("timestamp'2026-01-01 00:00:00'"), 3600), b"key")
    gone = held.join(first.select(F.col("fingerprint").alias("request_fingerprint"), "request_id"), "request_fingerprint").where("request_id % 4 = 3").select(F.col("grant_id").alias("grant_key"))
    none = spark.createDataFrame([], "grant_key string, uses_consumed int")
    told = approve(rows, held, none, gone, F.expr("timestamp'2026-01-01 00:30:00'"))
    return told.select(F.col("request_id").alias("c_custkey"), F.col("field_no").cast("long").alias("field_no"), F.col("accepted").isNotNull().alias("accepted"), "problem")


@query(
    """SELECT status, count(*)::BIGINT AS grants, sum(a)::BIGINT AS uses_allowed, sum(u)::BIGINT AS uses_consumed, sum(CASE WHEN status = 'active' THEN a - u ELSE 0 END)::BIGINT AS uses_left FROM (
      SELECT 2 AS a, c_custkey % 3 AS u, CASE WHEN c_custkey % 7 = 0 THEN 'revoked' WHEN c_custkey % 5 = 0 THEN 'expired' WHEN c_custkey % 3 >= 2 THEN 'exhausted' ELSE 'active' END AS status FROM customer) GROUP BY status"""
)
def grant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2026-06-01 00:00:00"))
    uses = table(spark, sf_dir, "customer").selectExpr("concat('g', cast(c_custkey as string)) AS grant_key", "2 AS uses_allowed", "cast(c_custkey % 3 as int) AS uses_consumed", "CASE WHEN c_custkey % 5 = 0 THEN timestamp'2026-06-01 00:00:00' ELSE timestamp'2026-07-01 00:00:00' END AS expires_at")
    return grants.summary(grants.statuses(uses, uses.where("cast(substr(grant_key, 2) as bigint) % 7 = 0").select("grant_key"), now))


# -- batches of files ------------------------------------------------------------------

_FILE = f"concat('姓名,备注', chr(10), {_NAME}, ',ok', chr(10)) AS content"
_NUMBERED = f"SELECT name, row_number() OVER (ORDER BY min(c_custkey)) AS n FROM (SELECT c_custkey, {_NAME} AS name FROM customer) GROUP BY name"


@query(f"SELECT c_custkey, concat('姓名,备注', chr(10), '[PERSON_NAME_', lpad(n::VARCHAR, 3, '0'), '],ok', chr(10)) AS sanitized FROM customer JOIN ({_NUMBERED}) ON name = {_NAME}")
def batch_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which one name has one token, numbered by its first file."""
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'csv' AS kind", _FILE)
    return batch.sanitize_batch(spread(files), file_no="c_custkey").select("c_custkey", "sanitized")


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'SANITIZE' ELSE 'BLOCK' END AS decision, c_custkey % 3 <> 2 AS released, CASE WHEN c_custkey % 3 = 1 THEN true END AS verification, count(*)::BIGINT AS files FROM customer GROUP BY ALL")
def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = f"CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN concat('姓名', chr(10), {_NAME}) ELSE ' ' END AS content"
    told = batch.sanitize_batch(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", "'csv' AS kind", content)), file_no="c_custkey")
    return batch.manifest(told, "c_custkey").groupBy("decision", "released", "verification").agg(F.count("*").alias("files"))


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 0 END::BIGINT AS n_rows, CASE c_custkey % 6 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '[1, null]' WHEN 5 THEN 'x' END AS a,
    CASE c_custkey % 6 WHEN 2 THEN 'the header is missing, empty or repeated' WHEN 3 THEN 'a row has another length than the header' WHEN 4 THEN 'a key is repeated' END AS problem FROM customer"""
)
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-set files read whole: their rows, or why they are no table."""
    content = """CASE c_custkey % 6 WHEN 0 THEN concat('a,b', chr(10), c_custkey, ',x', chr(10), chr(10), c_custkey, ',"y,z"') WHEN 1 THEN '{"a": [1, null], "b": "x"}' WHEN 2 THEN concat('a,a', chr(10), '1,2')
      WHEN 3 THEN concat('a,b', chr(10), '1') WHEN 4 THEN '[{"a": 1, "a": 2}]' ELSE '[{"a": "x"}, {"a": "x", "b": null}]' END AS content"""
    told = with_rows(table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 6 IN (0, 2, 3) THEN 'csv' ELSE 'json' END AS kind", content))
    return told.select("c_custkey", F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("n_rows"), F.get("rows", F.lit(0))["a"].alias("a"), "problem").withColumn("n_rows", F.greatest("n_rows", F.lit(0)))


# -- benchmark ------------------------------------------------------------------------

_AROUND = "CASE c_custkey % 7 WHEN 0 THEN concat('年龄', v, '岁') WHEN 1 THEN concat('1', v) WHEN 2 THEN concat(v, '0') WHEN 3 THEN concat(v, '以上') WHEN 4 THEN concat('不足', v) WHEN 5 THEN concat('9-', v, ' 又 ', v) ELSE 'x' END"


@query("SELECT c_custkey, c_custkey % 7 IN (0, 5) AS survives FROM customer")
def values_surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by itself against pieces of longer numbers and bands."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(cast(c_custkey % 50 + 20 as string), '.5') AS v").selectExpr("c_custkey", "v", f"{_AROUND} AS released")
    return rows.select("c_custkey", scoring.survives(F.col("v"), F.col("released")).alias("survives"))


_OUTCOME = """o_orderpriority AS document_type, o_orderkey % 5 AS tp, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS fn, o_orderkey % 5 + CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS labelled_spans,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS residual_spans, o_orderkey % 3 <> 0 AS released, o_orderkey % 3 = 1 AS allowed_original, o_orderkey % 3 = 2 AS sanitized_verified, o_orderkey % 3 = 2 AS verification_ran, o_orderkey % 6 = 2 AS verification_failed, o_orderkey % 17 = 0 AS lifecycle_failed,
  CASE o_orderkey % 19 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatch' END AS audit_failure, CASE WHEN o_orderkey % 23 = 0 THEN 'parser' END AS error,
  CASE o_orderkey % 3 WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'SANITIZE' ELSE 'ASK' END AS actual_verdict, CASE WHEN o_orderkey % 4 = 0 THEN 'ALLOW' ELSE 'SANITIZE' END AS expected_verdict"""

#: The measures of a group of outcomes, spelled out.
_MEASURES = """count(*)::BIGINT AS documents, count(*) FILTER (WHERE labelled_spans = 0)::BIGINT AS clean_documents, sum(tp + fn)::BIGINT AS labelled_spans, sum(fn)::BIGINT AS false_negatives,
    CASE WHEN sum(tp + fn) > 0 THEN round(sum(tp) / sum(tp + fn), 4) ELSE 1.0 END::DOUBLE AS recall, CASE WHEN sum(tp + fp) > 0 THEN round(sum(tp) / sum(tp + fp), 4) ELSE 1.0 END::DOUBLE AS precision,
    sum(fp)::BIGINT AS false_positives, coalesce(sum(fp) FILTER (WHERE labelled_spans = 0), 0)::BIGINT AS false_positives_on_clean_documents, sum(residual_spans)::BIGINT AS residual, count(*) FILTER (WHERE released)::BIGINT AS released_documents,
    count(*) FILTER (WHERE allowed_original)::BIGINT AS allowed_original_documents, count(*) FILTER (WHERE sanitized_verified)::BIGINT AS sanitized_verified_documents, count(*) FILTER (WHERE actual_verdict = 'ASK')::BIGINT AS ask_documents,
    count(*) FILTER (WHERE actual_verdict = 'BLOCK')::BIGINT AS blocked_documents, count(*) FILTER (WHERE verification_ran)::BIGINT AS verification_runs, count(*) FILTER (WHERE verification_failed)::BIGINT AS verification_failures,
    count(*) FILTER (WHERE lifecycle_failed)::BIGINT AS lifecycle_failures, count(audit_failure)::BIGINT AS audit_failures, count(*) FILTER (WHERE audit_failure = 'missing')::BIGINT AS audit_missing, count(*) FILTER (WHERE audit_failure = 'invalid')::BIGINT AS audit_invalid,
    count(*) FILTER (WHERE audit_failure = 'mismatch')::BIGINT AS audit_mismatch, count(*) FILTER (WHERE audit_failure = 'read_error')::BIGINT AS audit_read_error, count(error)::BIGINT AS errors,
    count(*) FILTER (WHERE actual_verdict <> expected_verdict)::BIGINT AS verdict_mismatch, count(*) FILTER (WHERE actual_verdict = 'ALLOW' AND expected_verdict <> 'ALLOW')::BIGINT AS false_allow"""
#: Gates by name and the condition under which a run fails them, in order.
_FAILED = """concat_ws(',', CASE WHEN false_allow > 0 THEN 'false_allow' END, CASE WHEN residual > 0 THEN 'residual_phi' END, CASE WHEN audit_leaks > 0 THEN 'audit_raw_leak' END, CASE WHEN errors > 0 THEN 'errors' END,
    CASE WHEN verification_failures > 0 THEN 'verification_failure' END, CASE WHEN lifecycle_failures > 0 THEN 'lifecycle_failure' END, CASE WHEN audit_failures > 0 THEN 'audit_failure' END, CASE WHEN false_negatives > 0 THEN 'incomplete_span_coverage' END,
    CASE WHEN sanitized_verified_documents = 0 OR verification_runs = 0 THEN 'sanitize_path_not_exercised' END, CASE WHEN verdict_mismatch > 0 THEN 'verdict_mismatch' END, CASE WHEN false_positives > 0 THEN 'false_positive' END) AS failed"""


@query(f"SELECT *, {_FAILED} FROM (SELECT document_type, {_MEASURES}, 0::BIGINT AS audit_leaks FROM (SELECT {_OUTCOME} FROM orders) GROUP BY document_type)")
def totals_by_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scoring.all_gates(scoring.totals_by(table(spark, sf_dir, "orders").selectExpr(_OUTCOME_STRUCT).select("o.*"), "document_type"))
    return told.drop("passed").withColumn("failed", F.array_join("failed", ","))


_OUTCOME_STRUCT = f"struct({_OUTCOME}) AS o"
_SLICES = """CASE WHEN o_orderkey % 3 <> 2 THEN 'nothing verified' WHEN o_orderkey % 6 <> 2 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 > 1 AND o_orderkey % 23 <> 0 AND o_orderkey % 4 <> 0 THEN 'sound'
  WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS part"""


@query(
    f"""WITH rows AS (SELECT {_SLICES}, {_OUTCOME} FROM orders), leaks AS (SELECT count(*)::BIGINT AS audit_leaks FROM nation WHERE n_nationkey < 3)
    SELECT part, failed, failed = '' AS passed FROM (SELECT *, {_FAILED} FROM (SELECT part, {_MEASURES} FROM rows GROUP BY part), leaks) UNION ALL
    SELECT concat(part, ', no leaks'), failed, failed = '' FROM (SELECT *, {_FAILED} FROM (SELECT part, {_MEASURES}, 0 AS audit_leaks FROM rows GROUP BY part))"""
)
def benchmark_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of four runs, one of them sound and one that verified nothing, with and without values in the audit."""
    rows = table(spark, sf_dir, "orders").selectExpr(_SLICES, _OUTCOME_STRUCT).select("part", "o.*")
    names = table(spark, sf_dir, "nation").selectExpr("n_name AS value", "n_nationkey")
    audit_text = names.where("n_nationkey < 3").selectExpr("""concat('{"event_id": "', value, '", "note": "', value, '"}') AS text""")
    noise = names.where("n_nationkey >= 3").selectExpr("""concat('{"event_hash": "', value, '"}') AS text""")
    totals = scoring.totals_by(rows, "part")
    told = scoring.all_gates(totals, scoring.leaked_values(audit_text.unionByName(noise), names))
    free = scoring.all_gates(totals).withColumn("part", F.concat("part", F.lit(", no leaks")))
    return told.unionByName(free).select("part", F.array_join("failed", ",").alias("failed"), "passed")


@query(
    """SELECT count(*)::BIGINT AS documents, 2 * count(*)::BIGINT AS labelled_values, count(*)::BIGINT AS kept_values, count(*) FILTER (WHERE c_custkey % 4 = 0)::BIGINT AS missed, count(*) FILTER (WHERE c_custkey % 4 = 1)::BIGINT AS over_redacted,
    count(*) FILTER (WHERE c_custkey % 4 = 3)::BIGINT AS withheld_documents, count(*) FILTER (WHERE c_custkey % 4 = 0) / (2 * count(*)) AS miss_rate, count(*) FILTER (WHERE c_custkey % 4 = 1) / count(*) AS over_redaction_rate FROM customer"""
)
def simulation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that keep a name, lose a clean word, rewrite all, or are withheld; a band that ends in the age is no miss."""
    released = "CASE c_custkey % 4 WHEN 0 THEN '张伟，20-29岁，咳嗽' WHEN 1 THEN 'x，20-29岁' WHEN 2 THEN 'x，20-29岁，咳嗽' END AS released"
    return scoring.simulation(table(spark, sf_dir, "customer").selectExpr(released, "array('张伟', '29岁') AS phi", "array('咳嗽') AS clean"))


@query("SELECT max(o_orderkey) AS seq, concat('h', max(o_orderkey)) AS event_hash FROM orders WHERE o_orderkey % 10 <> 7")
def audit_chain_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_head(_log(spark, sf_dir).select("seq", F.when(F.col("seq") % 10 != 7, F.concat(F.lit("h"), F.col("seq").cast("string"))).alias("event_hash")))


# -- notes with many facts ----------------------------------------------------------------

_PARTS = list(NOTES.values())
_SEGMENTS = 4


def _part(which: int, k: str) -> str:
    """One part of the segment k: its type, what is before, the value, or what is behind."""
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN " + (f"'{p[0]}'" if which == 0 else f"concat({p[which]})") for i, p in enumerate(_PARTS)) + " END"


_CHOSEN = [f"(c_custkey + {s} * (1 + cast(floor(c_custkey / {len(_PARTS)}) as int) % 5)) % {len(_PARTS)}" for s in range(_SEGMENTS)]
_LINES = [f"concat({_part(1, k)}, {_part(2, k)}, {_part(3, k)})" for k in _CHOSEN]
_STARTS = [" + ".join(["0", *(f"length({line}) + 1" for line in _LINES[:s]), f"length({_part(1, k)})"]) for s, k in enumerate(_CHOSEN)]


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT c_custkey, {_part(0, k)} AS type, ({start})::BIGINT AS start, {_part(2, k)} AS value FROM customer" for k, start in zip(_CHOSEN, _STARTS, strict=True)) + ") WHERE type <> 'MEDICAL_CONTENT'"
)
def detect_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors at once over notes of four lines with a fact each, in changing company.

    Words of medical content stand in several lines beside their facts, so that type is left out on both sides.
    """
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat_ws(chr(10), {', '.join(_LINES)}) AS text")
    found = with_facts(spread(notes), "text", "facts").select("c_custkey", F.explode("facts").alias("f")).where("f.type <> 'MEDICAL_CONTENT'")
    return found.select("c_custkey", "f.type", F.col("f.start").cast("long").alias("start"), "f.value")
