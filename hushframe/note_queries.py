"""Queries over generated notes and over variants of labelled notes; the SQL says what each must hold.

Notes and seeds are made from the rows of ``customer``, so their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.rows import spread
from hushframe.operators import mutate, scoring
from hushframe.operators.detect import with_facts
from hushframe.queries import _NAME, query, table
from hushframe.sources import notes

_LABELS_SQL = notes.corpus_sql("customer", "c_custkey")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.with_notes(spread(table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey")


def _facts(rows: DataFrame) -> DataFrame:
    return with_facts(spread(rows), "text", "facts").select("doc_id", F.inline("facts")).select("doc_id", "type", "start", "end", "value")


def _wide_places(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query(_LABELS_SQL)
def generated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a note for each customer, with what the text holds at their places."""
    told = _notes(spark, sf_dir).select("doc_id", "text", F.inline("spans"))
    return _wide_places(told.select("doc_id", "type", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("value")))


@query(_LABELS_SQL)
def detect_generated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors at once over notes of all shapes, clean ones among them, find the labels and nothing else."""
    return _wide_places(_facts(_notes(spark, sf_dir)))


@query(f"SELECT type, count(*)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS over_redaction FROM ({_LABELS_SQL}) GROUP BY type")
def generated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision by type over the generated notes."""
    rows = _notes(spark, sf_dir)
    return scoring.rates(scoring.align(_facts(rows), notes.labels(rows)), "type")


@query(
    f"""WITH labels AS ({_LABELS_SQL}), told AS (SELECT doc_id, bool_or(type = 'RARE_CONTEXT') AS rare FROM labels WHERE type <> 'MEDICAL_CONTENT' GROUP BY doc_id)
    SELECT CASE WHEN rare IS NULL THEN 'ALLOW' WHEN rare THEN 'ASK' ELSE 'SANITIZE' END AS expected_verdict, count(*)::BIGINT AS notes FROM customer LEFT JOIN told ON c_custkey = doc_id GROUP BY ALL"""
)
def generated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).groupBy("expected_verdict").agg(F.count("*").alias("notes"))


# -- variants of labelled notes -----------------------------------------------------------

_K = "cast(c_custkey % 100000000 as string)"
_EIGHT = f"lpad({_K}, 8, '0')"
_AGE = "(10 + cast(c_custkey % 90 as int))"
_TENS, _ONES = f"cast(floor({_AGE} / 10) as int)", f"{_AGE} % 10"
_SPELLED = f"concat(CASE WHEN {_TENS} = 1 THEN '' ELSE substr('一两三四五六七八九', {_TENS}, 1) END, '十', CASE WHEN {_ONES} = 0 THEN '' ELSE substr('一两三四五六七八九', {_ONES}, 1) END, '岁')"
_MONTH, _DAY = "(cast(c_custkey % 12 as int) + 1)", "(cast(c_custkey % 28 as int) + 1)"
_TEXT = lambda x: f"cast({x} as string)"
_TWO = lambda x: f"lpad({_TEXT(x)}, 2, '0')"
_FULL = lambda x: f"translate({x}, '0123456789-.', '０１２３４５６７８９－．')"
_SEX = "CASE WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END"
_PHONE = f"concat('138', {_EIGHT})"
_ISO, _CN = f"concat('2023-', {_TWO(_MONTH)}, '-', {_TWO(_DAY)})", f"concat('2023年', {_TEXT(_MONTH)}, '月', {_TEXT(_DAY)}, '日')"
_GROUPS = lambda v, sep, *cuts: f"concat_ws('{sep}', {', '.join(f'substr({v}, {a}, {n})' for a, n in cuts)})"

#: Seeds by c_custkey % 4: named parts of a text in order, the labels among them, clean values, verdict.
_SEEDS: tuple[tuple[dict[str, str], dict[str, str], tuple[str, ...], str], ...] = (
    (
        {"opener": "'今日查房'", "a": "'，患者'", "sep": "'：'", "name": _NAME, "b": "'，'", "sex": _SEX, "c": "'，'", "age": f"concat({_TEXT(_AGE)}, '岁')", "d": "'，'", "label": "'联系电话'", "e": "'：'", "phone": _PHONE, "f": "'，'", "date": _ISO, "verb": "'主诉'", "g": "'头痛'"},
        {"name": "PERSON_NAME", "sex": "SEX", "age": "AGE", "phone": "PHONE", "date": "EXACT_DATE"}, (), "SANITIZE",
    ),
    (
        {"label": "'身份证号'", "sep": "''", "id": f"concat('1101051990', {_EIGHT})", "a": "'，电话'", "phone": f"concat('138 ', substr({_EIGHT}, 1, 4), ' ', substr({_EIGHT}, 5, 4))", "b": "'，于'", "date": _CN, "c": "'复查'"},
        {"id": "GOVERNMENT_ID", "phone": "PHONE", "date": "EXACT_DATE"}, (), "SANITIZE",
    ),
    (
        {"phrase": "'多见于'", "age": "'六十岁'", "a": "'以上人群，'", "ask": "'建议'", "b": "'会诊，'", "ward": "'本病区'", "bed": "'床位紧张'", "c": "', '", "n": _K},
        {}, ("'六十岁'", "'本病区'"), "ALLOW",
    ),
    (
        {"label": "'座机'", "open": "'（'", "line": f"concat('010-', {_EIGHT})", "close": "'）'", "a": "'，'", "date": "'二〇二三年十二月三日'", "b": "'记录，'", "mrn_label": "'住院号'", "c": "'：'", "mrn": f"concat('ZY', {_EIGHT})"},
        {"line": "LANDLINE", "date": "EXACT_DATE", "mrn": "MEDICAL_RECORD_NUMBER"}, (), "ASK",
    ),
)

_FILLED = ({"behind": f"'{mutate.FILLERS[0]}'"}, {"before": f"'{mutate.FILLERS[1]}'"})
_SECOND = {"behind": "'另：患者'", "name2": "'王五'", "b2": "'，电话'", "phone2": "'13800005678'", "end2": "'。'"}

#: For each seed the operators that apply, and the parts that each of their variants writes otherwise.
_EXPECTED: tuple[dict[str, tuple[dict[str, str], ...]], ...] = (
    {
        "phone_regroup": ({"phone": _GROUPS(_PHONE, " ", (1, 3), (4, 4), (8, 4))}, {"phone": _GROUPS(_PHONE, "-", (1, 3), (4, 4), (8, 4))}),
        "date_restyle": ({"date": _CN}, {"date": f"replace({_ISO}, '-', '/')"}),
        "label_alias": ({"label": "'电话'"},),
        "separator_swap": ({"sep": "':'"}, {"sep": "'='"}, {"sep": "' '"}),
        "label_drop": ({"a": "'，'", "sep": "''"},),
        "value_split_ws": ({"phone": f"concat('138', ' ', {_EIGHT})"}, {"phone": f"concat('138', chr(10), {_EIGHT})"}),
        "anchor_verb_swap": ({"verb": "'诉'"},),
        "sex_style_swap": ({"sex": f"concat({_SEX}, '性')"},),
        "age_numeral_swap": ({"age": _SPELLED},),
        "time_opener_swap": ({"opener": "'今晨查房'"},),
        "splice_filler": _FILLED,
        "splice_second_patient": (_SECOND,),
    },
    {
        "phone_regroup": ({"phone": _PHONE},),
        "date_restyle": ({"date": _ISO}, {"date": f"concat('2023/', {_TEXT(_MONTH)}, '/', {_TEXT(_DAY)})"}),
        "id_spacing": ({"id": f"concat('110105 1990', substr({_EIGHT}, 1, 4), ' ', substr({_EIGHT}, 5, 4))"},),
        "label_alias": ({"label": "'身份证号码'"},),
        "separator_swap": ({"sep": "'：'"}, {"sep": "':'"}, {"sep": "'='"}),
        "label_drop": ({"label": "''"},),
        "value_split_ws": ({"id": f"concat('1101051990', ' ', {_EIGHT})"}, {"id": f"concat('1101051990', chr(10), {_EIGHT})"}),
        "splice_filler": _FILLED,
        "splice_second_patient": (_SECOND,),
    },
    {
        "population_age_swap": ({"age": "'60岁'"}, {"age": "'七十岁'"}, {"phrase": "'好发于'"}),
        "referral_style_swap": ({"ask": "'拟请'"}, {"ask": "'请'"}),
        "generic_reference_swap": ({"ward": "'各病区'"}, {"ward": "'该病区'"}, {"bed": "'床位不足'"}),
        "splice_filler": _FILLED,
    },
    {
        "date_restyle": ({"date": "'2023年12月3日'"},),
        "label_alias": ({"mrn_label": "'住院号码'"},),
        "separator_swap": ({"open": "'：'", "close": "''"}, {"open": "''", "close": "''"}),
        "label_drop": ({"mrn_label": "''", "c": "''"},),
        "value_split_ws": ({"line": f"concat('010-', substr({_EIGHT}, 1, 4), ' ', substr({_EIGHT}, 5, 4))"}, {"line": f"concat('010-', substr({_EIGHT}, 1, 4), chr(10), substr({_EIGHT}, 5, 4))"}),
        "splice_filler": _FILLED,
    },
)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled seed for each customer; places are lengths of the parts before."""
    case = lambda xs: "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    text, spans, clean = [], [], []
    for parts, labels, free, _ in _SEEDS:
        names = list(parts)
        text.append(f"concat({', '.join(parts.values())})")
        start = lambda n, names=names, parts=parts: " + ".join(["0", *(f"length({parts[m]})" for m in names[: names.index(n)])])
        spans.append("cast(array(" + ", ".join(f"named_struct('type', '{t}', 'start', {start(n)}, 'end', {start(n)} + length({parts[n]}))" for n, t in labels.items()) + ") as array<struct<type:string,start:int,end:int>>)")
        clean.append(f"cast(array({', '.join(free)}) as array<string>)")
    verdict = case([f"'{v}'" for *_, v in _SEEDS])
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", f"{case(text)} AS text", f"{case(spans)} AS labels", f"{case(clean)} AS clean", f"{verdict} AS verdict")


def _variants_sql() -> str:
    """The expected texts, part by part, and their labels at the places where the parts come to stand."""
    told = []
    for k, ((parts, labels, free, verdict), operators) in enumerate(zip(_SEEDS, _EXPECTED, strict=True)):
        wide = {n: _FULL(v) for n, v in parts.items()}
        for operator, changes in {"digits_fullwidth": (wide,), **operators}.items():
            for n, change in enumerate(changes, 1):
                whole = {**({"before": change["before"]} if "before" in change else {}), **parts, **change}
                whole = {"before": whole.pop("before"), **whole} if "before" in whole else whole
                own = {} if operator.endswith(("_age_swap", "referral_style_swap", "reference_swap")) else {**labels, **({"name2": "PERSON_NAME", "phone2": "PHONE"} if "name2" in change else {})}
                names = list(whole)
                start = lambda x, names=names, whole=whole: " + ".join(["0", *(f"length({whole[m]})" for m in names[: names.index(x)])])
                spans = ", ".join(f"{{'type': '{t}', 'start': ({start(x)})::BIGINT, 'value': {whole[x]}}}" for x, t in own.items())
                swapped = {parts[p]: v for p, v in change.items() if p in parts} if operator != "digits_fullwidth" else {parts[p]: v for p, v in wide.items()}
                clean = ", ".join(swapped.get(c, c) for c in free)
                told.append(
                    f"SELECT concat({_K}, '__{operator}_{n}') AS doc_id, '{operator}' AS operator, concat({', '.join(whole.values())}) AS text, array_to_string([{clean}]::VARCHAR[], ',') AS clean, '{verdict}' AS expected_verdict, "
                    f"[{spans}]::STRUCT(type VARCHAR, start BIGINT, value VARCHAR)[] AS labels FROM customer WHERE c_custkey % 4 = {k}"
                )
    return " UNION ALL ".join(told)


_VARIANTS_SQL = _variants_sql()


@query(f"SELECT doc_id, operator, text, clean, expected_verdict, len(labels)::BIGINT AS n_labels, NULL::VARCHAR AS refused FROM ({_VARIANTS_SQL})")
def mutation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all seventeen operators."""
    told = mutate.variants(_seeds(spark, sf_dir))
    return told.select("doc_id", "operator", "text", F.array_join("clean", ",").alias("clean"), "expected_verdict", F.size("labels").cast("long").alias("n_labels"), "refused")


@query(f"SELECT doc_id, operator, x.type AS type, x.start AS start, x.start + length(x.value) AS \"end\", x.value AS value FROM (SELECT doc_id, operator, unnest(labels) AS x FROM ({_VARIANTS_SQL}))")
def mutation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of every variant, moved with the edits."""
    return _wide_places(mutate.variants(_seeds(spark, sf_dir)).select("doc_id", "operator", F.inline("labels")))


#: Operators that change only how a value or its label is written, in ways that all detectors read.
_READABLE = ("digits_fullwidth", "phone_regroup", "date_restyle", "label_alias", "separator_swap", "splice_filler", "splice_second_patient", "sex_style_swap", "age_numeral_swap", "time_opener_swap")


#: Of those, the two behind which a sex is not read: its long form, and a short one before a spelled age.
_UNREAD_SEX = ("sex_style_swap", "age_numeral_swap")


@query(f"SELECT operator, x.type AS type, count(*)::BIGINT AS labels, count(*) FILTER (WHERE x.type <> 'SEX' OR operator NOT IN {_UNREAD_SEX})::BIGINT AS found FROM (SELECT operator, unnest(labels) AS x FROM ({_VARIANTS_SQL}) WHERE operator IN {_READABLE}) WHERE x.type IN ('PHONE', 'EXACT_DATE', 'LANDLINE', 'SEX', 'AGE') GROUP BY ALL")
def mutation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of variants that detection still finds at their places, by operator and type."""
    told = ("PHONE", "EXACT_DATE", "LANDLINE", "SEX", "AGE")
    # what has no label of these types counts nowhere, so nothing is looked for in it
    rows = mutate.variants(spread(_seeds(spark, sf_dir)), _READABLE).where(F.exists("labels", lambda x: x["type"].isin(*told)))
    kept = with_facts(rows, "text", "facts").select("operator", "facts", F.inline("labels")).where(F.col("type").isin(*told))
    hit = F.exists("facts", lambda f: (f["type"] == F.col("type")) & (f["start"] == F.col("start")) & (f["end"] == F.col("end")))
    return kept.groupBy("operator", "type").agg(F.count("*").alias("labels"), F.count(F.when(hit, 1)).alias("found"))
