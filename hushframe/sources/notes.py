"""Synthetic clinical notes with labelled spans, made in the executors from a grammar.

A note is a fixed number of sections, a section one of several lines, a line a row of parts:
literal words and slots, each slot with the type of what it holds and the way it is written.
Every choice is a *draw*: a hash of the seed, the note's key, the section and the slot.
Nothing depends on the order of rows, so a note is the same however the rows are
partitioned, and further notes change none that are there.  All of it is one projection.

Nothing here is of a real person: names come from short lists, numbers from prefixes that
are not assigned, addresses of machines and mail from the ranges kept for examples.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import lexicon as L
from hushframe.functions.spans import with_fenced

#: SQL text of a draw below n for a slot.
Draw = Callable[[str, int], str]

SURNAMES, COMPOUND = ("张", "王", "李", "赵", "刘", "陈", "杨", "周", "吴", "徐"), ("欧阳", "司马", "诸葛", "慕容")
GIVEN = ("伟", "芳", "娜", "敏", "静", "磊", "洋", "艳", "杰", "涛", "秀兰", "桂英", "玉梅", "建国", "海燕", "文博")
AREAS, STREETS = ("北京市朝阳区", "上海市徐汇区", "成都市武侯区", "西安市新城区"), ("幸福路", "梧桐巷", "柳林路", "和平街")
HOSPITALS, CLINICS = ("华山", "仁和", "康宁", "和谐"), ("心内科", "神经外科", "骨科", "消化内科", "呼吸内科")
SPOKEN_DIGITS, SPOKEN_MONTHS = "〇一二三四五六七八九", ("一", "二", "三", "五", "八", "十", "十一", "十二")


def _pick(d: Draw, slot: str, words: tuple[str, ...]) -> str:
    return f"split_part('{'|'.join(words)}', '|', cast({d(slot, len(words))} as int) + 1)"


def _digits(d: Draw, slot: str, n: int) -> str:
    return f"lpad(cast({d(slot, 10**n)} as string), {n}, '0')"


def _between(d: Draw, slot: str, low: int, high: int) -> str:
    return f"cast({d(slot, high - low + 1)} + {low} as string)"


def _joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _wide(sql: str) -> str:
    return f"translate({sql}, '0123456789-', '０１２３４５６７８９－')"


def _resident(d: Draw, gaps: bool = False, wrong: int = 0) -> str:
    """A number of 18 places whose last one fits the others; ``wrong`` moves it."""
    heads = ("11010519900101", "31010419851123", "44030420010206")
    sums = tuple(str(sum(int(c) * w for c, w in zip(h, L.ID_WEIGHTS))) for h in heads)
    tail = [d(f"id{i}", 10) for i in range(3)]
    total = f"(cast({_pick(d, 'head', sums)} as int) + " + " + ".join(f"{t} * {w}" for t, w in zip(tail, L.ID_WEIGHTS[14:])) + f" + {wrong})"
    last = f"substring('{L.ID_CHECK}', cast({total} % 11 as int) + 1, 1)"
    head = _pick(d, "head", heads)
    serial = _joined(*(f"cast({t} as string)" for t in tail), last)
    return _joined(f"substring({head}, 1, 6)", "' '", f"substring({head}, 7, 8)", "' '", serial) if gaps else _joined(head, serial)


#: How each kind of value is written: SQL that Spark and other engines read alike.
KINDS: dict[str, Callable[[Draw], str]] = {
    "person": lambda d: _joined(_pick(d, "surname", SURNAMES), _pick(d, "given", GIVEN)),
    "compound": lambda d: _joined(_pick(d, "surname", COMPOUND), _pick(d, "given", GIVEN)),
    "ordinal": lambda d: _joined(_pick(d, "surname", SURNAMES), _pick(d, "given", ("一", "二", "三", "五"))),
    "latin_person": lambda d: _joined(_pick(d, "first", ("John", "Mary", "Ann", "Peter")), "' '", _pick(d, "last", ("Smith", "O''Neil", "Lee-Jones"))),
    "phone": lambda d: _joined("'138000'", _digits(d, "n", 5)),
    "phone_spaced": lambda d: _joined("'138 000'", _digits(d, "a", 1), "' '", _digits(d, "b", 4)),
    "phone_wide": lambda d: _wide(_joined("'138000'", _digits(d, "n", 5))),
    "resident": _resident,
    "resident_spaced": lambda d: _resident(d, gaps=True),
    "resident_wrong": lambda d: _resident(d, wrong=1),
    "email": lambda d: _joined("'synth'", _digits(d, "n", 4), "'@example.'", _pick(d, "tld", ("com", "org"))),
    "url": lambda d: _joined("'https://example.org/report/IMG'", _digits(d, "n", 5)),
    "ip": lambda d: _joined(_pick(d, "net", ("192.0.2.", "198.51.100.")), _between(d, "n", 10, 250)),
    "date": lambda d: _joined("'2026-'", f"lpad({_between(d, 'm', 1, 12)}, 2, '0')", "'-'", f"lpad({_between(d, 'd', 1, 28)}, 2, '0')"),
    "date_slash": lambda d: _joined("'2026/'", _between(d, "m", 1, 12), "'/'", _between(d, "d", 1, 28)),
    "date_american": lambda d: _joined(_between(d, "m", 1, 12), "'/'", _between(d, "d", 1, 28), "'/2026'"),
    "date_chinese": lambda d: _joined("'2026年'", _between(d, "m", 1, 12), "'月'", _between(d, "d", 1, 28), "'日'"),
    "date_wide": lambda d: _wide(_joined("'2026-'", f"lpad({_between(d, 'm', 1, 12)}, 2, '0')", "'-'", f"lpad({_between(d, 'd', 1, 28)}, 2, '0')")),
    "date_spoken": lambda d: _joined("'二〇二'", f"substring('{SPOKEN_DIGITS}', cast({d('y', 7)} as int) + 1, 1)", "'年'", _pick(d, "m", SPOKEN_MONTHS), "'月'", _pick(d, "d", SPOKEN_MONTHS), "'日'"),
    "landline": lambda d: _joined(_pick(d, "area", ("010", "021", "0755")), "'-'", _between(d, "n", 60000000, 89999999)),
    "landline_wide": lambda d: _wide(_joined("'021-'", _between(d, "n", 60000000, 89999999))),
    "record": lambda d: _joined("'ZY2026'", _digits(d, "n", 4)),
    "record_wide": lambda d: _wide(_joined("'2026'", _digits(d, "n", 5))),
    "address": lambda d: _joined(_pick(d, "area", AREAS), _pick(d, "street", STREETS), _between(d, "n", 1, 99), "'号'"),
    "village": lambda d: _joined(_pick(d, "area", AREAS), _between(d, "n", 1, 9), "'栋'", _between(d, "u", 1, 9), "'单元'"),
    "specimen": lambda d: _joined("'SP'", _digits(d, "n", 6)),
    "accession": lambda d: _joined("'IM'", _digits(d, "n", 7)),
    "postal": lambda d: _between(d, "n", 100000, 999999),
    "social": lambda d: _joined("'user_'", _digits(d, "n", 4)),
    "hospital": lambda d: _joined(_pick(d, "name", HOSPITALS), _pick(d, "end", ("医院", "医疗中心", "卫生院"))),
    "clinic": lambda d: _pick(d, "name", CLINICS),
    "ward": lambda d: _joined(_pick(d, "n", ("三", "五", "十", "12")), "'病区'"),
    "named_ward": lambda d: _joined(_pick(d, "n", ("东", "西", "南")), "'楼病区'"),
    "bed": lambda d: _joined(_between(d, "n", 1, 90), "'床'"),
    "bed_number": lambda d: _joined(_pick(d, "row", ("", "A", "B")), _between(d, "n", 1, 90)),
    "age": lambda d: _joined(_between(d, "n", 18, 96), _pick(d, "unit", ("岁", "周岁"))),
    "age_months": lambda d: _joined(_between(d, "n", 1, 24), _pick(d, "unit", ("个月", "月大", "个月龄"))),
    "age_months_old": lambda d: _joined(_between(d, "n", 1, 24), "'个月大'"),
    "age_spoken": lambda d: _joined(_pick(d, "n", ("八", "十六", "三十五", "七十", "两")), "'岁'"),
    "sex": lambda d: _pick(d, "n", ("男", "女")),
    "sex_long": lambda d: _pick(d, "n", ("男性", "女性")),
    "unique": lambda d: _joined(_pick(d, "n", ("本县", "本市", "全国", "全省")), "'唯一'"),
    "first_case": lambda d: _pick(d, "n", ("国内首例", "世界首例", "首例报道")),
    "rare": lambda d: _pick(d, "n", ("罕见变异型病例", "极罕见疾病", "罕见综合征")),
    "oldest": lambda d: _joined(_between(d, "n", 100, 119), "'岁以上'"),
    "medical": lambda d: _pick(d, "n", ("用药", "检验", "过敏史", "diagnosis", "HIV")),
    "number": lambda d: _between(d, "n", 60, 110),
    "dose": lambda d: _digits(d, "n", 6),
}

#: Lines by section; a slot is ``{type:kind}``, and ``{:kind}`` is a value without a label.
SECTIONS: dict[str, tuple[str, ...]] = {
    "identity": (
        "患者：{PERSON_NAME:person}，性别：{SEX:sex}，年龄：{AGE:age}。",
        "姓名 {PERSON_NAME:compound}，{AGE:age}。",
        "患者姓名（{PERSON_NAME:person}）。",
        "{PERSON_NAME:person}，{SEX:sex}，{AGE:age}。",
        "，{PERSON_NAME:person}诉头痛。",
        "，{PERSON_NAME:compound}因跌倒来诊。",
        "name: {PERSON_NAME:latin_person}, seen today.",
        "患儿{AGE:age_months}，精神可。",
        "年龄：{AGE:age_months}，一般可。",
        "已{AGE:age_months_old}，发育可。",
        "年龄{AGE:age_spoken}。",
        "患者，{SEX:sex_long}，精神可。",
        "该{SEX:sex}性患者步入诊室。",
        "姓名：{PERSON_NAME:ordinal}。",
    ),
    "contact": (
        "联系电话：{PHONE:phone}，座机 {LANDLINE:landline}。",
        "手机 {PHONE:phone_spaced}；微信：{SOCIAL_MEDIA_ID:social}。",
        "电话{PHONE:phone_wide}，固话{LANDLINE:landline_wide}。",
        "邮箱：{EMAIL:email}，邮编：{POSTAL_CODE:postal}。",
        "网页 {URL:url} ，来自 {IP_ADDRESS:ip} 。",
        "家庭住址：{PRECISE_LOCATION:address}。",
        "现住{PRECISE_LOCATION:village}，独居。",
        "QQ号={SOCIAL_MEDIA_ID:social}；邮政编码 {POSTAL_CODE:postal}。",
    ),
    "numbers": (
        "身份证号：{GOVERNMENT_ID:resident}。",
        "证件 {GOVERNMENT_ID:resident_spaced}。",
        "证件号码 {GOVERNMENT_ID:resident_wrong}，待核对。",
        "病案号：{MEDICAL_RECORD_NUMBER:record}。",
        "登记号（{MEDICAL_RECORD_NUMBER:record_wide}）。",
        "MRN: {MEDICAL_RECORD_NUMBER:record}.",
        "标本号：{SPECIMEN_ID:specimen}，样本编号={SPECIMEN_ID:specimen}。",
        "检查号：{ACCESSION_NUMBER:accession}；影像编号 {ACCESSION_NUMBER:accession}。",
    ),
    "visit": (
        "{EXACT_DATE:date}来诊，转入{DEPARTMENT:clinic}。",
        "于{EXACT_DATE:date_slash}复查。",
        "随访 {EXACT_DATE:date_american} 。",
        "{EXACT_DATE:date_chinese}就诊于{HOSPITAL_NAME:hospital}。",
        "记录 {EXACT_DATE:date_wide} 。",
        "{EXACT_DATE:date_spoken}首次记录。",
        "科室：{DEPARTMENT:clinic}，{BED_NUMBER:bed}。",
        "{DEPARTMENT:clinic}门诊随访，床号：{BED_NUMBER:bed_number}。",
        "送至{HOSPITAL_NAME:hospital}，{WARD:ward}。",
        "，{WARD:named_ward}。",
    ),
    "staff": (
        "主治医师：{DOCTOR_NAME:person}，责任护士：{NURSE_NAME:person}。",
        "由{DOCTOR_NAME:person}医生查看。",
        "经治医师{DOCTOR_NAME:compound}签字。",
        "，{NURSE_NAME:person}护士测量。",
        "护士长{NURSE_NAME:person}巡视。",
        "其妻：{RELATIVE_NAME:person}，陪同。",
        "父亲{RELATIVE_NAME:person}陪同。",
        "家属 配偶 {RELATIVE_NAME:person}。",
        "手术助手：{DOCTOR_NAME:compound}。",
    ),
    "context": (
        "血压平稳，脉搏{:number}次/分。",
        "{:medical_word}完善，体温正常。",
        "{RARE_CONTEXT:unique}，已上报。",
        "{RARE_CONTEXT:first_case}，已讨论。",
        "本例为{RARE_CONTEXT:rare}，已讨论。",
        "已{RARE_CONTEXT:oldest}，精神可。",
        "查体配合，饮食可。",
        "血压平稳，心率{:number}次/分，饮食可。",
    ),
}
#: Notes without an identifier: words that look like one and are none.
CLEAN = (
    "男病房已消毒，床位紧张。",
    "共12名医生在岗，责任护士交接班。",
    "主任医师查房，患者一般情况可。",
    "本病区设备完好，各病区巡视。",
    "多见于60岁以上人群。",
    "药液{:dose}单位静滴，体温36.5。",
    "上级医院进一步评估。",
    "2026年3月复查，症状较前减轻。",
    "血压120/80，脉搏{:number}次/分。",
    "家属陪同，患者要求离开。",
    "三级甲等医院标准。",
    "邮编：12345，微信：abc。",
)
TYPES = ("outpatient_note", "inpatient_progress", "discharge_summary", "imaging_report", "lab_report", "operation_note", "consultation_note")
#: Sections of the notes of each type; all have as many.
LAYOUT = {
    "outpatient_note": ("identity", "contact", "visit", "numbers", "context"),
    "inpatient_progress": ("identity", "visit", "staff", "numbers", "context"),
    "discharge_summary": ("identity", "contact", "numbers", "staff", "visit"),
    "imaging_report": ("identity", "numbers", "visit", "contact", "context"),
    "lab_report": ("identity", "numbers", "numbers", "staff", "visit"),
    "operation_note": ("identity", "staff", "staff", "numbers", "visit"),
    "consultation_note": ("contact", "identity", "staff", "visit", "context"),
}
_MEDICAL = re.compile(f"({L.MEDICAL})", re.IGNORECASE)
KINDS["medical_word"] = KINDS["medical"]


def parts_of(line: str) -> list[tuple[str, str, bool]]:
    """(type, words or kind, slot) of the parts of a line; medical words are labelled as such wherever they stand."""
    out: list[tuple[str, str, bool]] = []
    for literal, kind, value in re.findall(r"([^{}]+)|\{([A-Z_]*):(\w+)\}", line):
        if value:
            out.append(("MEDICAL_CONTENT" if value == "medical_word" else kind, value, True))
        else:
            out += [("MEDICAL_CONTENT" if i % 2 else "", words, False) for i, words in enumerate(_MEDICAL.split(literal)) if words]
    return [*out, ("", "\n", False)]


def _lines() -> tuple[list[str], dict[str, tuple[int, int]]]:
    """All lines in a row, and where each section's begin and how many there are."""
    lines, place = [], {}
    for name, own in {**SECTIONS, "clean": CLEAN}.items():
        place[name] = len(lines), len(own)
        lines += own
    return lines, place


def grammar(array: Callable[[list[str]], str], struct: Callable[[str, str], str], draw: Callable[[str, int], str], pick: Callable[[list[int], str], str]) -> tuple[str, str]:
    """(number of the line, its parts) as SQL over ``note_type``, ``clean``, ``section`` and ``line``, in the dialect of the functions given."""
    lines, place = _lines()
    width = len(LAYOUT[TYPES[0]])
    starts, counts = ([place[s][i] for t in TYPES for s in LAYOUT[t]] for i in (0, 1))
    cell = f"note_type * {width} + section"
    first, many = place["clean"]
    number = f"CASE WHEN clean THEN {first} + {draw('line', 9973)} % {many} ELSE {pick(starts, cell)} + {draw('line', 9973)} % {pick(counts, cell)} END"
    branches = []
    for i, line in enumerate(lines):
        parts = []
        for k, (kind, words, slot) in enumerate(parts_of(line)):
            value = KINDS[words](lambda s, n, k=k: draw(f"{k}{s}", n)) if slot else "chr(10)" if words == "\n" else f"'{words}'"
            parts.append(struct(kind, value))
        branches.append(f"WHEN {i} THEN {array(parts)}")
    return number, f"CASE line {' '.join(branches)} END"


def _draw(seed: int) -> Callable[[str, int], str]:
    return lambda slot, n: f"(cast(conv(substring(md5(concat('{seed}:', note, ':', cast(section as string), ':{slot}')), 1, 7), 16, 10) as bigint) % {n})"


def with_notes(rows: DataFrame, key: str, seed: int = 20260912) -> DataFrame:
    """(doc_id, document_type, corpus_role, text, spans, expected_verdict, text_policy) for each row, by its key alone.

    ``spans`` are (type, start, end, value) in code points.  A fifth of the notes is clean: any
    span found there is wrong.  Verdicts follow from the labels: none ALLOW, a rare
    context ASK, else SANITIZE.  A null key counts as an empty text.
    """
    draw = _draw(seed)
    number, parts = grammar(
        lambda xs: f"array({', '.join(xs)})", lambda t, v: f"named_struct('type', '{t}', 'text', {v})", draw, lambda xs, at: f"element_at(array({', '.join(map(str, xs))}), cast({at} + 1 as int))"
    )
    head = lambda slot, n: draw(slot, n).replace("cast(section as string)", "'head'")
    notes = rows.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("note"))
    notes = notes.selectExpr("*", f"cast({head('type', len(TYPES))} as int) AS note_type", f"{head('role', 5)} = 0 AS clean")
    width = len(LAYOUT[TYPES[0]])
    notes = notes.withColumn("lines", F.expr(f"transform(sequence(0, {width - 1}), section -> struct(section, cast({number} as int) AS line))"))
    body = parts.replace("CASE line ", "CASE x.line ").replace("cast(section as string)", "cast(x.section as string)")
    # fenced: a filter on the spans would otherwise go down to the scan and repeat the grammar for each part
    notes = with_fenced(notes, parts=F.expr(f"flatten(transform(lines, x -> {body}))"))
    at = "named_struct('type', p.type, 'start', a.place, 'end', a.place + length(p.text), 'value', p.text)"
    none = "cast(array() as array<struct<type:string,start:int,end:int,value:string>>)"
    spans = f"aggregate(parts, named_struct('place', 0, 'found', {none}), (a, p) -> named_struct('place', a.place + length(p.text), 'found', IF(p.type = '', a.found, concat(a.found, array({at})))), a -> a.found)"
    types = F.array("note_type")
    told = with_fenced(notes, text=F.array_join("parts.text", ""), spans=F.expr(spans)).select(
        "doc_id", F.element_at(F.array(*map(F.lit, TYPES)), F.get(types, F.lit(0)) + 1).alias("document_type"), F.when(F.col("clean"), "negative").otherwise("positive").alias("corpus_role"), "text", "spans",
    )
    identifiers = F.filter("spans", lambda s: s["type"] != "MEDICAL_CONTENT")
    verdict = F.when(F.size(identifiers) == 0, "ALLOW").when(F.exists(identifiers, lambda s: s["type"] == "RARE_CONTEXT"), "ASK").otherwise("SANITIZE")
    return told.withColumn("expected_verdict", verdict).withColumn("text_policy", F.lit("do_not_store_in_audit"))


def corpus(spark: SparkSession, notes: int, seed: int = 20260912) -> DataFrame:
    """So many notes, numbered from 0."""
    return with_notes(spark.range(notes), "id", seed)


def write_corpus(notes: DataFrame, path: str) -> None:
    """A new folder of JSON lines, a note with its labels in each; an existing one is never written over."""
    notes.write.mode("errorifexists").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    shape = "doc_id string, document_type string, corpus_role string, text string, spans array<struct<type:string,start:int,end:int,value:string>>, expected_verdict string, text_policy string"
    return spark.read.schema(shape).json(path)


def labels(notes: DataFrame) -> DataFrame:
    """(doc_id, type, start, end, value) rows of the labels, as scoring takes them."""
    return notes.select(F.col("doc_id"), F.inline("spans"))


def corpus_sql(table: str, key: str, seed: int = 20260912) -> str:
    """The labels of ``with_notes`` over a table, in the SQL of DuckDB: parts in rows, places as running sums."""
    draw = lambda slot, n: f"(('0x' || substring(md5(concat('{seed}:', note, ':', section, ':{slot}')), 1, 7))::BIGINT % {n})"
    number, parts = grammar(lambda xs: f"[{', '.join(xs)}]", lambda t, v: f"{{'type': '{t}', 'text': {v}}}", draw, lambda xs, at: f"([{', '.join(map(str, xs))}])[({at} + 1)::INT]")
    head = lambda slot, n: draw(slot, n).replace("section", "'head'")
    width = len(LAYOUT[TYPES[0]])
    return f"""
WITH notes AS (SELECT {key} AS doc_id, {key}::VARCHAR AS note FROM {table}),
kinds AS (SELECT *, {head('type', len(TYPES))}::INT AS note_type, {head('role', 5)} = 0 AS clean FROM notes),
sections AS (SELECT *, unnest(range(0, {width}))::INT AS section FROM kinds),
lines AS (SELECT *, ({number})::INT AS line FROM sections),
parts AS (SELECT doc_id, section, {parts} AS parts FROM lines),
rows AS (SELECT doc_id, section, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM parts),
placed AS (SELECT doc_id, p.type AS type, p.text AS value, coalesce(sum(length(p.text)) OVER (PARTITION BY doc_id ORDER BY section, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows)
SELECT doc_id, type, start::BIGINT AS start, (start + length(value))::BIGINT AS "end", value FROM placed WHERE type <> ''"""
