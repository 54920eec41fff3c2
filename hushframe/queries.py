"""Queries over the driver's tables, each with the same answer in SQL where SQL has one.

Clinical notes are made from the rows of ``customer`` by the same string expression
in Spark and in SQL, so that the expected spans follow from the parts of the string
and not from a second set of patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.rows import spread
from hushframe.functions.spans import merge, strip_invisible
from hushframe.operators import audit, chat, dataset, dicom, grants, scoring
from hushframe.operators.detect import detect, with_facts
from hushframe.operators.dictionary import dictionary_facts
from hushframe.operators.transform import age_band, month_of_date, shift_days, shifted_date
from hushframe.operators.verify import names_end_well
from hushframe.plans.guard import evaluate, sanitize
from hushframe.plans.policy import PROFILES, decide, risk_level, risk_score
from hushframe.plans.records import sanitize_records
from hushframe.sources.admission import is_binary, kind_of
from hushframe.sources.structured import with_leaves
from hushframe.streaming.requests import guard_lines, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- detectors on notes -----------------------------------------------------

_KEY8 = "lpad(cast(c_custkey % 100000000 as string), 8, '0')"
_NAME = "concat(substr('张李王刘陈', cast(c_custkey % 5 as int) + 1, 1), substr('伟芳娜敏', cast(c_custkey % 4 as int) + 1, 1))"
_ID17 = "concat('11010519900101', lpad(cast(c_custkey % 1000 as string), 3, '0'))"
#: The weighted sum of 11010519900101 is 120; the last three digits have the weights 8, 4 and 2.
_ID_SUM = "(120 + cast(floor(c_custkey % 1000 / 100) as int) * 8 + cast(floor(c_custkey % 100 / 10) as int) * 4 + cast(c_custkey % 10 as int) * 2)"
_ID_LAST = f"substr('10X98765432', cast({_ID_SUM} % 11 as int) + 1, 1)"
_ID_WRONG = f"substr('10X98765432', cast(({_ID_SUM} + 1) % 11 as int) + 1, 1)"

#: detector -> (type, text before, value, text behind, a near miss); parts are SQL expressions.
NOTES: dict[str, tuple[str, str, str, str, str]] = {
    "cn_phone": ("PHONE", "'联系电话 '", f"concat('138', {_KEY8})", "' 已核对'", f"concat('电话 1381', {_KEY8})"),
    "email": ("EMAIL", "'邮箱：'", "concat('u', cast(c_custkey as string), '@mail.example.com')", "'，'", "'邮箱：user@localhost'"),
    "url": ("URL", "'见 '", "concat('https://h.example.org/p/', cast(c_custkey as string))", "'，谢谢'", "'见 ftp://h.example.org'"),
    "ipv4": ("IP_ADDRESS", "'来自 '", "concat('10.', cast(c_custkey % 256 as string), '.1.7')", "' 访问'", "'来自 999.1.1.1'"),
    "exact_date": ("EXACT_DATE", "'于'", "concat('2023年', cast(c_custkey % 12 + 1 as string), '月', cast(c_custkey % 28 + 1 as string), '日')", "'就诊'", "'于2023-02-30就诊'"),
    "landline": ("LANDLINE", "'座机 '", f"concat('010-', {_KEY8})", "'。'", f"concat('座机 10-', {_KEY8})"),
    "person_field": ("PERSON_NAME", "'患者：'", _NAME, "'，入院'", "'患者，入院'"),
    "medical_record_field": ("MEDICAL_RECORD_NUMBER", "'住院号：'", f"concat('ZY', {_KEY8})", "'。'", "'住院号：AB'"),
    "precise_location_field": ("PRECISE_LOCATION", "'住址：'", "concat('北京市朝阳区建国路', cast(c_custkey as string), '号')", "'。'", "'住址：甲乙'"),
    "specimen_id": ("SPECIMEN_ID", "'标本号='", "concat('S', cast(c_custkey as string))", "'。'", "'标本号='"),
    "accession_number": ("ACCESSION_NUMBER", "'检查号 （'", "concat('CT-', cast(c_custkey as string))", "'）'", "'检查号缺失'"),
    "postal_code": ("POSTAL_CODE", "'邮编：'", "lpad(cast(c_custkey % 1000000 as string), 6, '1')", "'。'", "'邮编：12345'"),
    "social_media_id": ("SOCIAL_MEDIA_ID", "'微信：'", f"concat('wx_', {_KEY8})", "'。'", "'微信：abc'"),
    "hospital_name": ("HOSPITAL_NAME", "'患者就诊于'", "concat(substr('华仁康同安', cast(c_custkey % 5 as int) + 1, 1), '山医院')", "'。'", "'转至上级医院'"),
    "department": ("DEPARTMENT", "'今日转入'", "CASE WHEN c_custkey % 2 = 0 THEN '心内科' ELSE '神经外科' END", "'。'", "'心内科说明'"),
    "ward": ("WARD", "'，'", "concat(substr('第东西南北', cast(c_custkey % 5 as int) + 1, 1), '三病区')", "'。'", "'，本病区'"),
    "bed_number": ("BED_NUMBER", "'，'", "concat(cast(c_custkey % 90 + 1 as string), '床')", "'。'", "'，5床位'"),
    "doctor_name": ("DOCTOR_NAME", "'主治医师：'", _NAME, "'。'", "'主治医师查房'"),
    "nurse_name": ("NURSE_NAME", "'责任护士：'", _NAME, "'。'", "'责任护士执行'"),
    "relative_name": ("RELATIVE_NAME", "'其妻：'", _NAME, "'。'", "'其妻陪同'"),
    "age": ("AGE", "'，'", "concat(cast(c_custkey % 90 + 10 as string), '岁')", "'，'", "concat('，纳入', cast(c_custkey % 90 + 10 as string), '岁')"),
    "sex": ("SEX", "'性别：'", "CASE WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END", "'，'", "'男方'"),
    "rare_context": ("RARE_CONTEXT", "'，'", "CASE WHEN c_custkey % 2 = 0 THEN '本县唯一' ELSE '国内首例' END", "'。'", "'，唯一'"),
    "medical_content_baseline": ("MEDICAL_CONTENT", "'x '", "CASE WHEN c_custkey % 2 = 0 THEN '诊断' ELSE 'Treatment' END", "' y'", "'x y'"),
    "recall_narrative_name": ("PERSON_NAME", "'，'", _NAME, "'主诉头痛'", "'，主诉头痛'"),
}


def _detector_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _, before, value, behind, miss = NOTES[name]
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"CASE WHEN c_custkey % 5 = 3 THEN {miss} ELSE concat({before}, {value}, {behind}) END AS text")
    found = with_facts(spread(notes), "text", "facts", [name]).select("c_custkey", F.explode("facts").alias("f"))
    return found.select("c_custkey", "f.type", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.value")


for _name, (_type, _before, _value, _behind, _miss) in NOTES.items():
    QUERIES[f"detect_{_name}"] = partial(_detector_query, _name)
    SQL[f"detect_{_name}"] = (
        f"SELECT c_custkey, '{_type}' AS type, length({_before})::BIGINT AS start, (length({_before}) + length({_value}))::BIGINT AS \"end\", {_value} AS value FROM customer WHERE c_custkey % 5 <> 3"
    )


@query(f"SELECT c_custkey, concat({_ID17}, CASE WHEN c_custkey % 5 = 3 THEN {_ID_WRONG} ELSE {_ID_LAST} END) AS value, CASE WHEN c_custkey % 5 = 3 THEN 0.4 ELSE 1.0 END::DOUBLE AS confidence FROM customer")
def detect_cn_id18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resident numbers with right and wrong check digits."""
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('身份证 ', {_ID17}, CASE WHEN c_custkey % 5 = 3 THEN {_ID_WRONG} ELSE {_ID_LAST} END, '。') AS text")
    found = with_facts(spread(notes), "text", "facts", ["cn_id18"]).select("c_custkey", F.explode("facts").alias("f"))
    return found.select("c_custkey", "f.value", "f.confidence")


@query("SELECT c_custkey, 'HOSPITAL_NAME' AS type, CASE WHEN c_custkey % 5 = 3 THEN 6 ELSE 4 END::BIGINT AS start, 'dictionary.institution' AS source FROM customer")
def detect_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest term of a dictionary, but not right behind a word of referral: there a shorter one begins later."""
    notes = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(CASE WHEN c_custkey % 5 = 3 THEN '建议转往' ELSE '复诊地点' END, '青松康复之家，周一') AS text")
    terms = [("青松康复之家", "institution"), ("康复之家", "institution")]
    found = with_facts(spread(notes), "text", "facts", [], [dictionary_facts(F.col("text"), terms)]).select("c_custkey", F.explode("facts").alias("f"))
    return found.select("c_custkey", "f.type", F.col("f.start").cast("long").alias("start"), "f.source")


# -- documents --------------------------------------------------------------

_MAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
_IP = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
_TYPES = "(VALUES ('EMAIL', 0), ('IP_ADDRESS', 1)) AS t(type, k)"
_FOUND = f"SELECT doc_id, type, unnest(regexp_extract_all(text, CASE k WHEN 0 THEN '{_MAIL}' ELSE '{_IP}' END)) AS value FROM documents, {_TYPES}"


@query(f"SELECT doc_id, type, value, count(*)::BIGINT AS n FROM ({_FOUND}) GROUP BY ALL")
def facts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of the whole documents, by value."""
    found = evaluate(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.explode("facts").alias("f"))
    return found.groupBy("doc_id", "f.type", "f.value").agg(F.count("*").alias("n")).select("doc_id", "type", "value", "n")


@query(f"SELECT type, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM ({_FOUND}) GROUP BY type")
def facts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.explode("facts").alias("f"))
    return found.groupBy("f.type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    f"""WITH f AS (SELECT doc_id, count(*) AS n FROM ({_FOUND}) GROUP BY doc_id)
    SELECT CASE WHEN n > 0 THEN 'SANITIZE' ELSE 'ALLOW' END AS verdict, true AS released, count(*)::BIGINT AS docs, sum(coalesce(n, 0))::BIGINT AS facts
    FROM documents LEFT JOIN f USING (doc_id) GROUP BY 1"""
)
def sanitize_documents_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and releases of all documents for an approved external recipient."""
    told = sanitize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return told.groupBy(F.col("decision.verdict").alias("verdict"), "released").agg(F.count("*").alias("docs"), F.sum(F.size("facts")).alias("facts"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_MAIL}', '[REDACTED]', 'g'), '{_IP}', '[REDACTED]', 'g')) AS text_md5 FROM documents")
def sanitize_documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = sanitize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return told.select("doc_id", F.md5("sanitized").alias("text_md5"))


@query("SELECT page_id, url AS value, 0::BIGINT AS start FROM pages")
def detect_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_facts(spread(table(spark, sf_dir, "pages")), "url", "facts", ["url"]).select("page_id", F.explode("facts").alias("f"))
    return found.select("page_id", "f.value", F.col("f.start").cast("long").alias("start"))


# -- normalisation and admission ---------------------------------------------


@query("SELECT c_custkey, c_name AS text FROM customer")
def strip_invisible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "'\u200b', substr(c_name, 4, 2), '\u202e', '\ufeff'"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat(substr(c_name, 1, 3), {marks}, substr(c_name, 6)) AS text").select("c_custkey", strip_invisible(F.col("text")).alias("text"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'fhir' WHEN 2 THEN 'text' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'unsupported' ELSE 'json' END AS kind FROM events")
def admission_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON (repeated keys and NaN too), FHIR, text, refused control characters and containers with more behind them told apart."""
    text = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{"resourceType": "Patient"}' WHEN 2 THEN concat('{', event_type) WHEN 3 THEN concat(event_type, chr(7))
      WHEN 4 THEN '{"a":1}{"b":2}' WHEN 5 THEN concat('{"a":1} ', event_type) WHEN 6 THEN '{"a":1,"a":2}' ELSE '{"a":NaN}' END"""
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS text").select("event_id", kind_of(F.col("text")).alias("kind"))


@query("SELECT event_id, event_id % 3 <> 2 AS is_binary FROM events")
def admission_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE event_id % 3 WHEN 0 THEN concat('a', chr(1)) WHEN 1 THEN concat('  %PDF-1.7', event_type) ELSE concat(event_type, chr(10), chr(9)) END"
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{text} AS text").select("event_id", is_binary(F.col("text")).alias("is_binary"))


# -- merging and policy -------------------------------------------------------


@query(
    """WITH RECURSIVE base AS (
      SELECT l_orderkey AS k, (l_partkey % 40)::BIGINT AS a, (l_partkey % 40 + 1 + l_suppkey % 9)::BIGINT AS b, ((l_quantity::BIGINT) % 4)::DOUBLE AS c,
             CASE WHEN l_linenumber % 3 = 0 THEN 'MEDICAL_CONTENT' ELSE 'PHONE' END AS t, l_linenumber AS o FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b DESC, c, t, o) AS i FROM base),
    fold AS (
      SELECT k, i, a, b, c, t, 1 AS slot FROM f WHERE i = 1
      UNION ALL
      SELECT f.k, f.i,
        CASE WHEN f.a >= p.b OR w THEN f.a ELSE p.a END, CASE WHEN f.a >= p.b OR w THEN f.b ELSE p.b END,
        CASE WHEN f.a >= p.b OR w THEN f.c ELSE p.c END, CASE WHEN f.a >= p.b OR w THEN f.t ELSE p.t END,
        CASE WHEN f.a >= p.b THEN p.slot + 1 ELSE p.slot END
      FROM fold p JOIN (SELECT * FROM f) f ON f.k = p.k AND f.i = p.i + 1,
      LATERAL (SELECT ((f.t <> 'MEDICAL_CONTENT')::INT, f.c, f.b - f.a) > ((p.t <> 'MEDICAL_CONTENT')::INT, p.c, p.b - p.a) AS w))
    SELECT k AS l_orderkey, max_by(a, i)::BIGINT AS start, max_by(b, i)::BIGINT AS "end", max_by(t, i) AS type FROM fold GROUP BY k, slot"""
)
def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over overlapping facts, on intervals made from line items."""
    fact = "named_struct('type', CASE WHEN l_linenumber % 3 = 0 THEN 'MEDICAL_CONTENT' ELSE 'PHONE' END, 'start', cast(l_partkey % 40 as int), 'end', cast(l_partkey % 40 + 1 + l_suppkey % 9 as int), 'confidence', cast(cast(l_quantity as bigint) % 4 as double), 'source', 's', 'value', '', 'read_only', false, 'ord', l_linenumber)"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(fact)).alias("facts"))
    kept = rows.select("l_orderkey", F.explode(merge(F.col("facts"))).alias("f"))
    return kept.select("l_orderkey", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.type")


_SETS = ["", "PHONE", "SEX", "MEDICAL_CONTENT", "RARE_CONTEXT", "GOVERNMENT_ID", "BIOMETRIC", "BIOMETRIC,GENETIC", "PHONE,MEDICAL_CONTENT", "UNLISTED", "AGE,SEX", "PARSER_FAILURE", "RARE_CONDITION"]
_TRUSTS = ["LOCAL", "INTERNAL_TRUSTED", "EXTERNAL_APPROVED", "EXTERNAL_UNKNOWN", "EXTERNAL_BLOCKED"]
_WHYS = ["TREATMENT", "RESEARCH", "UNKNOWN"]
_STRICT = PROFILES["external-ai-strict"]
_SCORES = {t: r for t, (_, r) in _STRICT.identifiers.items()} | _STRICT.medical


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + f") AS {names}"


_MATRIX = f"(SELECT a.types, b.trust, c.purpose FROM {_values([(x,) for x in _SETS], 'a(types)')}, {_values([(x,) for x in _TRUSTS], 'b(trust)')}, {_values([(x,) for x in _WHYS], 'c(purpose)')})"
_HAS = lambda t: f"list_contains(string_split(types, ','), '{t}')"


@query(
    f"""SELECT types, trust, purpose,
      CASE WHEN trust = 'EXTERNAL_BLOCKED' THEN 'BLOCK' WHEN {_HAS('GOVERNMENT_ID')} AND trust IN ('EXTERNAL_UNKNOWN', 'EXTERNAL_BLOCKED') THEN 'BLOCK'
        WHEN types = 'BIOMETRIC,GENETIC' AND trust LIKE 'EXTERNAL%' THEN 'BLOCK' WHEN types = 'PARSER_FAILURE' THEN 'BLOCK'
        WHEN types = '' THEN 'ALLOW' WHEN {_HAS('BIOMETRIC')} OR {_HAS('GENETIC')} THEN 'BLOCK' WHEN types = 'UNLISTED' THEN 'BLOCK' WHEN purpose = 'UNKNOWN' THEN 'ASK'
        WHEN types LIKE 'RARE%' AND trust IN ('EXTERNAL_UNKNOWN', 'EXTERNAL_APPROVED') THEN 'ASK' WHEN {_HAS('MEDICAL_CONTENT')} AND trust = 'EXTERNAL_UNKNOWN' THEN 'ASK'
        WHEN {_HAS('PHONE')} OR {_HAS('AGE')} OR {_HAS('GOVERNMENT_ID')} THEN 'SANITIZE' WHEN types IN ('SEX', 'MEDICAL_CONTENT', 'RARE_CONTEXT') THEN 'ALLOW' ELSE 'BLOCK' END AS verdict,
      (SELECT coalesce(sum(coalesce(s.risk, 25)), 0) FROM (SELECT unnest(string_split(types, ',')) AS t) LEFT JOIN {_values(list(_SCORES.items()), 's(type, risk)')} ON s.type = t WHERE t <> '')::BIGINT
        + CASE trust WHEN 'EXTERNAL_APPROVED' THEN 10 WHEN 'EXTERNAL_UNKNOWN' THEN 20 WHEN 'EXTERNAL_BLOCKED' THEN 100 ELSE 0 END
        + CASE purpose WHEN 'RESEARCH' THEN 5 WHEN 'UNKNOWN' THEN 30 ELSE 0 END AS risk_score
    FROM {_MATRIX}"""
)
def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict cascade over fact sets, recipients and purposes."""
    rows = spark.createDataFrame([(x,) for x in _SETS], "types string").crossJoin(spark.createDataFrame([(x,) for x in _TRUSTS], "trust string")).crossJoin(spark.createDataFrame([(x,) for x in _WHYS], "purpose string"))
    facts = F.transform(F.filter(F.split("types", ","), lambda t: t != ""), lambda t: F.struct(t.alias("type"), F.lit(False).alias("read_only")))
    told = rows.withColumn("d", decide(facts, F.col("trust"), F.col("purpose"), _STRICT))
    return told.select("types", "trust", "purpose", "d.verdict", F.col("d.risk_score").cast("long").alias("risk_score"))


@query(
    """SELECT p_partkey, s::BIGINT AS risk_score, CASE WHEN s <= 20 THEN 'LOW' WHEN s <= 50 THEN 'MEDIUM' WHEN s <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
    FROM (SELECT p_partkey, 15 + CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 35 ELSE 75 END AS s FROM part)"""
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and levels of type sets: none, a phone, a phone and a URL, and those with an ID."""
    types = "CASE p_size % 4 WHEN 0 THEN array() WHEN 1 THEN array('PHONE') WHEN 2 THEN array('PHONE', 'URL') ELSE array('PHONE', 'URL', 'GOVERNMENT_ID') END"
    score = risk_score(F.expr(types).cast("array<string>"), F.lit("LOCAL"), F.lit("EXTERNAL_AI_ASSISTANCE"), _STRICT)
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("long").alias("risk_score")).withColumn("risk_level", risk_level(F.col("risk_score")))


# -- rewriting ------------------------------------------------------------------

_FULL = f"concat('患者', {_NAME}, '，性别：男，', cast(c_custkey % 80 + 10 as string), '岁，电话138', {_KEY8}, '，于2023年5月', cast(c_custkey % 28 + 1 as string), '日就诊，住院号：ZY', {_KEY8}, '。')"


@query("SELECT c_custkey, concat('患者[PERSON_NAME_001]，性别：男，', CAST(floor((c_custkey % 80 + 10) / 10) * 10 AS INT), '-', CAST(floor((c_custkey % 80 + 10) / 10) * 10 + 9 AS INT), '岁，电话[REDACTED]，于2023年5月就诊，住院号：[REDACTED]。') AS sanitized, true AS released FROM customer")
def sanitize_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole notes: tokens, bands, generalised dates and removals in one text, verified."""
    told = sanitize(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_FULL} AS text")))
    return told.select("c_custkey", "sanitized", "released")


@query(
    f"""WITH s AS (SELECT c_custkey, text, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 730 - 365 AS d FROM (SELECT c_custkey, {_FULL} AS text FROM customer)),
    t AS (SELECT c_custkey, date '2023-05-01' + CAST(c_custkey % 28 AS INT) + CAST(CASE WHEN d = 0 THEN 365 ELSE d END AS INT) AS day FROM s)
    SELECT c_custkey, concat(year(day), '年', month(day), '月', day(day), '日') AS shifted FROM t"""
)
def transform_date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved by the offset of their text, in the research profile."""
    told = sanitize(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_FULL} AS text")), profile="research")
    return told.select("c_custkey", F.regexp_extract("sanitized", "于([0-9]+年[0-9]+月[0-9]+日)就诊", 1).alias("shifted"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '1-9岁' ELSE concat(CAST(floor(p_size / 10) * 10 AS INT), '-', CAST(floor(p_size / 10) * 10 + 9 AS INT), '岁') END AS band FROM part WHERE p_size >= 1")
def transform_age_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size >= 1").select("p_partkey", age_band(F.concat(F.col("p_size").cast("string"), F.lit("岁"))).alias("band"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') ELSE concat(year(o_orderdate), '年', month(o_orderdate), '月') END AS month FROM orders")
def transform_date_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/M/d') ELSE date_format(o_orderdate, 'yyyy年M月d日') END"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS v").select("o_orderkey", month_of_date(F.col("v")).alias("month"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CASE WHEN s = 0 THEN 365 ELSE s END, '%Y-%m-%d') AS shifted FROM (SELECT *, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 730 - 365 AS INT) AS s FROM orders)")
def date_shift_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("v"))
    return rows.select("o_orderkey", shifted_date(F.col("v"), shift_days(F.col("o_orderkey").cast("string"))).alias("shifted"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS fine FROM customer")
def verify_name_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that goes on behind its span must not be released."""
    behind = "CASE c_custkey % 3 WHEN 0 THEN '爽，' WHEN 1 THEN '，' ELSE '入院' END"
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat('护士：', '郑', {behind}) AS text")
    done = F.array(F.struct(F.lit("NURSE_NAME").alias("type"), F.lit(4).alias("end")))
    return rows.select("c_custkey", names_end_well(F.col("text"), done).alias("fine"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ALLOW' ELSE 'SANITIZE' END AS after FROM customer")
def decision_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shifted date is still a date: the decision on the output says so, and the release holds."""
    text = f"CASE WHEN c_custkey % 2 = 0 THEN concat('电话138', {_KEY8}) ELSE concat('于2023年5月', cast(c_custkey % 28 + 1 as string), '日') END AS text"
    told = sanitize(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", text)), profile="research").where("released")
    return told.select("c_custkey", F.col("decision_after.verdict").alias("after"))


# -- structured payloads ----------------------------------------------------------


@query("SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS text, true AS read_only FROM events")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("content"), F.lit("json").alias("kind"))
    return with_leaves(rows).select("event_id", F.explode("leaves").alias("x")).select("event_id", "x.path", "x.text", "x.read_only")


_DOC = f"concat('{{\"name\": \"', {_NAME}, '\", \"phone\": ', CASE WHEN c_custkey % 4 = 0 THEN concat('138', {_KEY8}) ELSE concat('\"138', {_KEY8}, '\"') END, '}}')"


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'ASK' ELSE 'SANITIZE' END AS verdict, CASE WHEN c_custkey % 4 <> 0 THEN concat('{', chr(10), '  \"name\": \"[PERSON_NAME_001]\",', chr(10), '  \"phone\": \"[REDACTED]\"', chr(10), '}') END AS sanitized FROM customer")
def json_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records: a phone in a number cannot be rewritten and asks; in a string it goes."""
    told = sanitize_records(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", "'json' AS kind", f"{_DOC} AS content")))
    return told.select("c_custkey", F.col("decision.verdict").alias("verdict"), "sanitized")


@query(f"SELECT c_custkey, concat('姓名,年龄,备注', chr(10), '[PERSON_NAME_001],', CAST(floor((c_custkey % 80 + 10) / 10) * 10 AS INT), '-', CAST(floor((c_custkey % 80 + 10) / 10) * 10 + 9 AS INT), '岁,ok', chr(10)) AS sanitized FROM customer")
def csv_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"concat('姓名,年龄,备注', chr(10), {_NAME}, ',', cast(c_custkey % 80 + 10 as string), '岁,ok', chr(10)) AS content"
    return sanitize_records(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", "'csv' AS kind", text))).select("c_custkey", "sanitized")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'BLOCK' ELSE 'SANITIZE' END AS verdict, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 2 END::BIGINT AS facts FROM customer")
def fhir_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a resource splits are found whole; unknown resources are closed."""
    kind = "CASE WHEN c_custkey % 3 = 0 THEN 'Provenance' ELSE 'Patient' END"
    text = f"concat('{{\"resourceType\": \"', {kind}, '\", \"name\": [{{\"family\": \"', substr({_NAME}, 1, 1), '\", \"given\": [\"', substr({_NAME}, 2, 1), '\"]}}]}}') AS content"
    told = sanitize_records(spread(table(spark, sf_dir, "customer").selectExpr("c_custkey", "'fhir' AS kind", text)))
    return told.select("c_custkey", F.col("decision.verdict").alias("verdict"), F.when(F.size("facts") > 0, F.size("facts").cast("long")).alias("facts"))


# -- data sets ---------------------------------------------------------------------

_CLASSES = "(SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_mktsegment)"


@query(
    f"""SELECT sum(c)::BIGINT AS row_count, count(*)::BIGINT AS group_count, min(c)::BIGINT AS smallest_group, max(c)::BIGINT AS largest_group, coalesce(sum(c) FILTER (WHERE c = 1), 0)::BIGINT AS singleton_rows,
    coalesce(sum(c) FILTER (WHERE c < 12), 0)::BIGINT AS small_group_rows, round(coalesce(sum(c) FILTER (WHERE c < 12), 0) / sum(c), 6) AS small_group_fraction FROM {_CLASSES}"""
)
def dataset_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.risk(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 12)
    return out.select("row_count", "group_count", "smallest_group", "largest_group", "singleton_rows", "small_group_rows", F.round("small_group_fraction", 6).alias("small_group_fraction"))


@query(f"SELECT c::BIGINT AS rows_per_group, count(*)::BIGINT AS groups FROM {_CLASSES} GROUP BY c")
def dataset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.class_sizes(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT 3::BIGINT AS group_count, count(*)::BIGINT AS row_count FROM events")
def dataset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and the numbers 40 and '40': three classes of four kinds of cells."""
    cell = "CASE event_id % 4 WHEN 0 THEN cast(NULL as string) WHEN 1 THEN '' WHEN 2 THEN '40' ELSE cast(40 as string) END AS cell"
    return dataset.risk(table(spark, sf_dir, "events").selectExpr(cell), ["cell"]).select("group_count", "row_count")


@query(
    """WITH f AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'PERSON_NAME' ELSE 'DOCTOR_NAME' END AS type, concat('v', c_nationkey) AS value, c_custkey % 3 AS file_no, 0 AS op_no, c_custkey AS start FROM customer),
    g AS (SELECT type, value, min((file_no, op_no, start)) AS first FROM f GROUP BY ALL)
    SELECT type, value, n::BIGINT AS number, concat('[', type, '_', lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0'), ']') AS token FROM (SELECT *, row_number() OVER (ORDER BY first, type, value) AS n FROM g)"""
)
def batch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN 'PERSON_NAME' ELSE 'DOCTOR_NAME' END AS type", "concat('v', cast(c_nationkey as string)) AS value", "c_custkey % 3 AS file_no", "0 AS op_no", "c_custkey AS start")
    return dataset.batch_tokens(facts).select("type", "value", F.col("number").cast("long").alias("number"), "token")


# -- audit and grants ---------------------------------------------------------------

_DECISION = "CASE o_orderkey % 4 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'SANITIZE' WHEN 2 THEN 'ASK' ELSE 'BLOCK' END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored audit events."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "concat('e', cast(o_orderkey as string)) AS event_id", "'2026-01-01T00:00:00.000000Z' AS timestamp", f"{_DECISION} AS decision",
        f"CASE WHEN {_DECISION} = 'SANITIZE' THEN array('CONTACT_IDENTIFIER_PRESENT', 'EXTERNAL_RECIPIENT') ELSE array('NO_SENSITIVE_DATA_DETECTED') END AS reason_codes",
        "map('PHONE', cast(o_orderkey % 3 as int)) AS entity_counts", "'LOW' AS risk_level", "10 AS risk_score", "'EXTERNAL_APPROVED' AS recipient_class", "'RESEARCH' AS purpose", "'external-ai-strict' AS policy_profile",
        "'external-ai-strict/1' AS policy_version", "array('REMOVE') AS transformations", "'PASS' AS verification", "false AS dictionary_loaded", "0 AS dictionary_entries", "'' AS grant_id", "'' AS grant_issuer",
    )


_EVENT_SQL = (
    "concat('{\"decision\": \"', decision, '\", \"dictionary_entries\": 0, \"dictionary_loaded\": false, \"entity_counts\": {\"PHONE\": ', k % 3, '}, \"event_id\": \"e', k, '\", \"grant_id\": \"\", \"grant_issuer\": \"\", "
    "\"policy_profile\": \"external-ai-strict\", \"policy_version\": \"external-ai-strict/1\", \"prev_hash\": \"', prev, '\", \"purpose\": \"RESEARCH\", \"reason_codes\": [', "
    "CASE WHEN decision = 'SANITIZE' THEN '\"CONTACT_IDENTIFIER_PRESENT\", \"EXTERNAL_RECIPIENT\"' ELSE '\"NO_SENSITIVE_DATA_DETECTED\"' END, '], \"recipient_class\": \"EXTERNAL_APPROVED\", \"risk_level\": \"LOW\", "
    "\"risk_score\": 10, \"timestamp\": \"2026-01-01T00:00:00.000000Z\", \"transformations\": [\"REMOVE\"], \"verification\": \"PASS\"}')"
)


@query(f"SELECT k AS seq, sha256({_EVENT_SQL}) AS event_hash FROM (SELECT o_orderkey AS k, {_DECISION} AS decision, 'p' || o_orderkey AS prev FROM orders)")
def audit_event_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of an event, hashed."""
    return _log(spark, sf_dir).withColumn("prev_hash", F.concat(F.lit("p"), F.col("seq").cast("string"))).select("seq", audit.event_hash().alias("event_hash"))


@query("SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE o_orderkey % 10 <> 7))::BIGINT AS chained, (count(*) FILTER (WHERE o_orderkey % 10 = 7))::BIGINT AS unchained, (count(*) FILTER (WHERE o_orderkey % 10 <> 7) - 1)::BIGINT AS failures FROM orders")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each claim to be the first: every link but one is broken; some have no hash."""
    log = _log(spark, sf_dir).withColumn("prev_hash", F.lit(""))
    log = log.withColumn("event_hash", F.when(F.col("seq") % 10 != 7, audit.event_hash()))
    return audit.chain_report(log)


@query(
    f"""WITH l AS (SELECT {_DECISION} AS d, o_orderkey % 3 AS e FROM orders)
    SELECT 'decision' AS section, d AS name, count(*)::BIGINT AS n FROM l GROUP BY d
    UNION ALL SELECT 'entity', 'PHONE', sum(e)::BIGINT FROM l
    UNION ALL SELECT 'reason', r, count(*)::BIGINT FROM (SELECT unnest(CASE WHEN d = 'SANITIZE' THEN ['CONTACT_IDENTIFIER_PRESENT', 'EXTERNAL_RECIPIENT'] ELSE ['NO_SENSITIVE_DATA_DETECTED'] END) AS r FROM l) GROUP BY r
    UNION ALL SELECT * FROM (SELECT unnest(['risk', 'recipient', 'purpose', 'verification', 'transformation']) AS section, unnest(['LOW', 'EXTERNAL_APPROVED', 'RESEARCH', 'PASS', 'REMOVE']) AS name, (SELECT count(*) FROM l)::BIGINT)"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(_log(spark, sf_dir))


@query(
    """WITH c AS (SELECT event_type AS section, concat('u', user_id % 20) AS name, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, first) AS k FROM c)
    SELECT section, CASE WHEN k <= 12 THEN name ELSE '(other)' END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2"""
)
def audit_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").selectExpr("event_type AS section", "concat('u', cast(user_id % 20 as string)) AS name", "event_id").groupBy("section", "name").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return audit.top(counts)


@query(
    """SELECT concat('g', c_custkey) AS grant_key, CASE WHEN c_custkey % 7 = 0 THEN 'revoked' WHEN c_custkey % 5 = 0 THEN 'expired' WHEN c_custkey % 3 >= 2 THEN 'exhausted' ELSE 'active' END AS status FROM customer
    UNION ALL SELECT concat('x', s_suppkey), 'revoked' FROM supplier"""
)
def grant_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2026-06-01 00:00:00"))
    uses = table(spark, sf_dir, "customer").selectExpr("concat('g', cast(c_custkey as string)) AS grant_key", "2 AS uses_allowed", "cast(c_custkey % 3 as int) AS uses_consumed", "CASE WHEN c_custkey % 5 = 0 THEN timestamp'2026-06-01 00:00:00' ELSE timestamp'2026-07-01 00:00:00' END AS expires_at")
    gone = uses.where("cast(substr(grant_key, 2) as bigint) % 7 = 0").select("grant_key").union(table(spark, sf_dir, "supplier").selectExpr("concat('x', cast(s_suppkey as string)) AS grant_key"))
    return grants.statuses(uses, gone, now).select("grant_key", "status")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'no grant' WHEN c_custkey % 6 = 1 THEN 'grant signature does not verify' WHEN c_custkey % 6 = 2 THEN 'grant is not yet valid' WHEN c_custkey % 6 = 3 THEN 'grant has expired'
    WHEN c_custkey % 6 = 4 THEN 'grant does not accept the risk of: PHONE' END AS problem FROM customer"""
)
def grant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    requests = rows.selectExpr("c_custkey", "sha2(cast(c_custkey as string), 256) AS fingerprint", "array('PHONE', 'URL') AS untransformable_types")
    held = rows.where("c_custkey % 6 <> 0").selectExpr(
        "sha2(cast(c_custkey as string), 256) AS request_fingerprint", "c_custkey % 6 <> 1 AS signature_valid", "CASE WHEN c_custkey % 6 = 2 THEN timestamp'2027-01-01 00:00:00' ELSE timestamp'2026-01-01 00:00:00' END AS issued_at",
        "CASE WHEN c_custkey % 6 = 3 THEN timestamp'2026-06-01 00:00:00' ELSE timestamp'2028-01-01 00:00:00' END AS expires_at", "CASE WHEN c_custkey % 6 = 4 THEN array('URL') ELSE array('URL', 'PHONE') END AS accepted_types",
    )
    return grants.check(requests, held, F.to_timestamp(F.lit("2026-06-01 00:00:00"))).select("c_custkey", "problem")


@query(
    """SELECT o_custkey AS grant_key, o_orderkey AS seq, o_custkey % 11 <> 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 <= 3 AS consumed FROM orders"""
)
def grant_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three uses of which one is spent, revoked keys get none."""
    attempts = table(spark, sf_dir, "orders").selectExpr("o_custkey AS grant_key", "o_orderkey AS seq", "timestamp'2026-01-01 00:00:00' AS at")
    uses = attempts.select("grant_key").distinct().selectExpr("grant_key", "3 AS uses_allowed", "1 AS uses_consumed", "timestamp'2026-02-01 00:00:00' AS expires_at")
    return grants.consume(attempts, uses, uses.where("grant_key % 11 = 0").select("grant_key"))


# -- scoring --------------------------------------------------------------------------

_LABELS = "SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'PHONE' ELSE 'AGE' END AS type, l_partkey % 50 AS start, l_partkey % 50 + 5 AS \"end\" FROM lineitem"
_FACTS = "SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'PHONE' ELSE 'AGE' END AS type, l_partkey % 50 + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS start, l_partkey % 50 + 5 AS \"end\" FROM lineitem WHERE l_suppkey % 7 <> 0"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'PHONE' ELSE 'AGE' END AS type", "l_partkey % 50 AS start", "l_partkey % 50 + 5 AS end")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 0").selectExpr("l_orderkey AS doc_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'PHONE' ELSE 'AGE' END AS type", "l_partkey % 50 + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS start", "l_partkey % 50 + 5 AS end")


_ALIGNED = f"""SELECT coalesce(a.type, b.type) AS type, least(coalesce(n, 0), coalesce(m, 0)) AS tp, greatest(coalesce(n, 0) - coalesce(m, 0), 0) AS fp, greatest(coalesce(m, 0) - coalesce(n, 0), 0) AS fn
    FROM (SELECT doc_id, type, start, "end", count(*) AS n FROM ({_FACTS}) GROUP BY ALL) a FULL JOIN (SELECT doc_id, type, start, "end", count(*) AS m FROM ({_LABELS}) GROUP BY ALL) b
    ON a.doc_id = b.doc_id AND a.type = b.type AND a.start = b.start AND a."end" = b."end" """


@query(f"SELECT type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / (sum(tp) + sum(fn)), 4) AS recall, round(sum(tp) / (sum(tp) + sum(fp)), 4) AS precision, round(sum(fp) / (sum(tp) + sum(fp)), 4) AS over_redaction FROM ({_ALIGNED}) GROUP BY type")
def scoring_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rates(scoring.align(_found(spark, sf_dir), _labels(spark, sf_dir)), "type")


@query(f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, 'recall,precision,false_positives' AS failed, false AS passed FROM ({_ALIGNED})")
def scoring_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.gates(scoring.rates(scoring.align(_found(spark, sf_dir), _labels(spark, sf_dir))))
    return out.select("tp", "fp", "fn", F.array_join("failed", ",").alias("failed"), "passed")


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def scoring_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")


@query(f"SELECT count(*)::BIGINT AS covered FROM ({_LABELS}) l WHERE EXISTS (SELECT 1 FROM ({_FACTS}) f WHERE f.doc_id = l.doc_id AND f.type = l.type AND f.start <= l.start AND f.\"end\" >= l.\"end\")")
def scoring_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.covered(_labels(spark, sf_dir), _found(spark, sf_dir)).agg(F.count("*").alias("covered"))


@query(f"SELECT count(*)::BIGINT AS untouched FROM ({_LABELS}) p WHERE NOT EXISTS (SELECT 1 FROM ({_FACTS}) f WHERE f.doc_id = p.doc_id AND f.start < p.\"end\" AND f.\"end\" > p.start)")
def scoring_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.untouched(_labels(spark, sf_dir), _found(spark, sf_dir)).agg(F.count("*").alias("untouched"))


@query("SELECT count(DISTINCT n_name)::BIGINT AS n_leaked FROM nation, region WHERE contains(concat(r_name, ' audit ', r_regionkey, ' ', CASE WHEN r_regionkey = 1 THEN (SELECT string_agg(n_name, ' ') FROM nation WHERE n_nationkey < 5) ELSE '' END), n_name)")
def audit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.where("n_nationkey < 5").agg(F.array_join(F.collect_list("n_name"), " ").alias("names"))
    texts = region.crossJoin(names).selectExpr("concat(r_name, ' audit ', cast(r_regionkey as string), ' ', CASE WHEN r_regionkey = 1 THEN names ELSE '' END) AS text")
    return scoring.leaked_values(texts, nation.selectExpr("n_name AS value"))


# -- requests and images -----------------------------------------------------------------


@query(
    """SELECT conv_id * 100 + turn AS request_id, 2::BIGINT AS n_fields, (CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_rewritten, CASE WHEN turn % 3 = 0 THEN 'blocked' ELSE 'release' END AS outcome,
    CASE WHEN turn % 3 = 0 THEN 403 ELSE 200 END AS status,
    CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 2 = 0 THEN '{"messages":[{"role":"user","content":"mail [REDACTED]"},{"role":"user","content":"ok"}]}' ELSE '{"messages": [{"role": "user", "content": "hello"}, {"role": "user", "content": "ok"}]}' END AS sent FROM conversations"""
)
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies with an address to rewrite, and images that are refused."""
    second = "CASE WHEN turn % 3 = 0 THEN '[{\"type\": \"image\"}]' ELSE '\"ok\"' END"
    body = f"concat('{{\"messages\": [{{\"role\": \"user\", \"content\": \"', CASE WHEN turn % 2 = 0 THEN 'mail a@b.example.com' ELSE 'hello' END, '\"}}, {{\"role\": \"user\", \"content\": ', {second}, '}}]}}') AS body"
    return chat.guard_requests(table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS request_id", body))


@query(
    """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'pass' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'forward' WHEN 3 THEN 'refuse' WHEN 4 THEN 'rewrite' WHEN 5 THEN 'rewrite' WHEN 6 THEN 'refuse'
      WHEN 7 THEN 'pass' WHEN 8 THEN 'rewrite' ELSE 'refuse' END AS action, false AS leaked FROM events"""
)
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-RPC lines, spaced and escaped in many ways: only calls are looked at, arrays with a call are refused whole, no address leaves a call."""
    line = """CASE event_id % 10
      WHEN 0 THEN concat('{"jsonrpc":"2.0","id":', event_id, ',"method":"tools/list"}')
      WHEN 1 THEN concat('{"jsonrpc":"2.0","id":', event_id, ',"method":"tools/call","params":{"arguments":{"q":"a@b.example.com"}}}')
      WHEN 2 THEN concat('{"jsonrpc":"2.0","id":', event_id, ',"method":"tools/call","params":{"arguments":{"q":"x"}}}')
      WHEN 3 THEN '[{"method":"tools/call"}]'
      WHEN 4 THEN concat('{"method": "tools/call", "id": ', event_id, ', "params": {"arguments": {"q": "mail a@b.example.com"}}}')
      WHEN 5 THEN concat('{"id":', event_id, ',"method":"tools/call","params":{"arguments":{"q":"x"},"inputResponses":{"r":"a@b.example.com"}}}')
      WHEN 6 THEN concat('[{"id":', event_id, ',"method" : "tools', chr(92), '/call", "params":{"arguments":{"q":"a@b.example.com"}}}]')
      WHEN 7 THEN concat('no message ', event_id)
      WHEN 8 THEN concat('{"id":', event_id, ',"method":"tools/call","params":{"arguments":"mail a', chr(92), 'u0040b.example.com"}}')
      ELSE concat('{"id":', event_id, ',"method":"tools/call","params":{"arguments":"{}{}"}}') END AS line"""
    told = guard_lines(spread(table(spark, sf_dir, "events").selectExpr("event_id", line)))
    return told.select("event_id", "action", F.coalesce(F.contains("out", F.lit("b.example.com")), F.lit(False)).alias("leaked"))


_TAGS = "CASE l_linenumber % 5 WHEN 0 THEN '00100010' WHEN 1 THEN '00080080' WHEN 2 THEN '0020000D' WHEN 3 THEN '00080020' ELSE '00280010' END"


@query(
    f"""SELECT l_orderkey, CASE l_linenumber % 5 WHEN 0 THEN 'Z' WHEN 2 THEN 'U' WHEN 3 THEN 'DATE' ELSE 'K' END AS action, CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 2 THEN 'uid' WHEN 3 THEN '20230111' ELSE '512' END AS value
    FROM lineitem WHERE l_linenumber % 5 <> 1"""
)
def dicom_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements removed, emptied, remapped, moved by ten days and kept."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "cast(l_orderkey as string) AS file", "'' AS seq_path", f"{_TAGS} AS tag", "CASE l_linenumber % 5 WHEN 0 THEN 'PN' WHEN 1 THEN 'LO' WHEN 2 THEN 'UI' WHEN 3 THEN 'DA' ELSE 'US' END AS vr", "'' AS keyword",
        "CASE l_linenumber % 5 WHEN 0 THEN 'A^B' WHEN 1 THEN 'Clinic' WHEN 2 THEN concat('1.2.3.', cast(l_partkey as string)) WHEN 3 THEN '20230101' ELSE '512' END AS value", "false AS is_private",
    )
    out = dicom.deidentify(rows, date_shift_days=10, salt=b"s")
    value = F.when(F.col("action") == "U", F.when(F.col("value").rlike(r"^2\.25\.[0-9]{59}$"), "uid")).otherwise(F.col("value"))
    return out.select("l_orderkey", "action", value.alias("value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS decision, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def audit_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by decision and hour, by the same windows as over a stream."""
    return windowed_counts(table(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) AS ts", "event_type AS decision"))


@query(
    """SELECT o_custkey % 50 AS kind, count(*)::BIGINT AS n, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS valid FROM orders GROUP BY o_custkey % 50"""
)
def grant_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued grants of which every third was changed after it was signed."""
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 50 AS kind", "concat('f', o_orderkey) AS fingerprint", "array('PHONE', 'AGE') AS accepted_types")
    given = grants.issue(asked, b"key", "desk", F.expr("timestamp'2026-01-01 00:00:00'"), 3600)
    changed = F.when(F.substring("request_fingerprint", 2, 30).cast("long") % 3 == 0, 99).otherwise(F.col("uses_allowed"))
    told = grants.with_validity(given.withColumn("uses_allowed", changed), b"key")
    rows = told.join(asked.select(F.col("fingerprint").alias("request_fingerprint"), "kind"), "request_fingerprint")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("signature_valid").cast("long")).alias("valid"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

