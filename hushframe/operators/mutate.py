"""Variants of labelled notes: seventeen ways in which a note might have been written otherwise.

Each operator reads a seed (text, labels, clean values, expected verdict) and proposes edit
scripts; one step applies every script, moves the labels with it, and refuses what can no
longer be judged.  Seeds times operators is a narrow projection and one generator: nothing
is shuffled, and a seed's variants come from the task that read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.edits import SCRIPT, SPAN, apply, edit, move_spans, script
from hushframe.functions.spans import let, with_fenced
from hushframe.operators.detect import numeral_table

# What an operator writes for what, in the order in which it is tried.
ALIASES = (
    ("联系电话", "电话"),
    ("身份证号码", "身份证"),
    ("身份证号", "身份证号码"),
    ("电子邮箱", "邮箱"),
    ("邮政编码", "邮编"),
    ("出生日期", "出生年月"),
    ("入院日期", "入院时间"),
    ("病历号", "病案号"),
    ("住院号", "住院号码"),
    ("手机号", "手机号码"),
    ("手机", "手机号"),
    ("座机", "固定电话"),
)
LABELS = (
    "联系电话",
    "身份证号码",
    "身份证号",
    "电子邮箱",
    "入院日期",
    "出生日期",
    "邮政编码",
    "医师签名",
    "责任护士",
    "主治医师",
    "住院号",
    "病历号",
    "手机号",
    "座机",
    "手机",
    "电话",
    "邮箱",
    "姓名",
    "患者",
    "家属",
    "床号",
    "科室",
    "助手",
)
SEPARATORS = ("：", ":", "=", " ")
VERBS = (("主诉", "诉"), ("自诉", "主诉"), ("诉", "主诉"), ("伴", "伴有"), ("收入", "收住"))
OPENERS = (("今日查房", "今晨查房"), ("今日", "今晨"), ("上午9时", "上午九时"), ("上午九时", "上午9时"))
POPULATIONS = (("多见于", "好发于"), ("多见于", "常见于"))
REFERRALS = (("建议", "拟请"), ("建议", "请"))
GENERICS = (("本病区", "各病区"), ("本病区", "该病区"), ("三级甲等医院", "三甲医院"), ("床位紧张", "床位不足"))
FILLERS = (
    "查体：神志清，精神可。",
    "双肺呼吸音清，未闻及干湿性啰音。",
    "饮食、睡眠可，二便正常。",
    "余无特殊不适。",
    "嘱注意休息，清淡饮食。",
)
SECOND_PATIENT = "另：患者王五，电话13800005678。"
SECOND_LABELS = (("PERSON_NAME", "王五"), ("PHONE", "13800005678"))
SPLIT_AT = {"PHONE": 3, "GOVERNMENT_ID": 10, "LANDLINE": 8, "MEDICAL_RECORD_NUMBER": 4}
ROLES = ("DOCTOR_NAME", "NURSE_NAME", "RELATIVE_NAME")

_VARIANT = f"struct<edits:{SCRIPT},source:string,target:string,wide:boolean,extra:array<struct<type:string,value:string>>,unlabelled:boolean>"
_DIGITS, _WIDE = "0123456789-.", "０１２３４５６７８９－．"


@dataclass(frozen=True)
class Seed:
    """Columns of a seed; labels are (type, start, end, value)."""

    text: Column
    labels: Column
    clean: Column
    verdict: Column


def _variant(*edits: Column, swap: tuple[Column | str, Column | str] = ("", ""), wide: bool = False, extra: Iterable[tuple[str, str]] = (), unlabelled: bool = False) -> Column:
    source, target = (F.lit(x) if isinstance(x, str) else x for x in swap)
    more = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in extra))
    return F.struct(script(*edits).alias("edits"), source.alias("source"), target.alias("target"), F.lit(wide).alias("wide"), more.alias("extra"), F.lit(unlabelled).alias("unlabelled")).cast(_VARIANT)


def _some(*variants: Column) -> Column:
    """The variants that are not null."""
    return F.array_compact(F.array(*variants)).cast(f"array<{_VARIANT}>")


def _where(condition: Column, *variants: Column) -> Column:
    return _some(*(F.when(condition, v) for v in variants))


def _labels_of(seed: Seed, *types: str) -> Column:
    return F.filter(seed.labels, lambda x: x["type"].isin(*types))


def _values(seed: Seed) -> Column:
    return F.transform(seed.labels, lambda x: x["value"])


def _pairs(pairs: Iterable[tuple[str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs))


def _replace_first(text: Column, source: Column, target: Column | str) -> Column:
    """An edit of the first occurrence."""
    at = F.instr(text, source)
    return edit(at - 1, at - 1 + F.length(source), target)


def _swap(seed: Seed, source: Column, target: Column | str) -> Column:
    """A variant that writes ``target`` for ``source`` in the text and in the clean values."""
    return _variant(_replace_first(seed.text, source, target), swap=(source, target))


def _one(array: Column, of: Callable[[Column], Column]) -> Column:
    """The variants of the first element, none if there is none."""
    return F.when(F.size(array) > 0, let(F.get(array, F.lit(0)), of)).otherwise(_some())


def _flat(array: Column, of: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(array, of))


def _over(label: Column, text: Column) -> Column:
    return edit(label["start"], label["end"], text)


def _ascii(value: Column) -> Column:
    return F.translate(value, "０１２３４５６７８９", "0123456789")


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def numerals() -> dict[str, str]:
    """Chinese numerals up to 99, as the numbers that they write."""
    return {k: str(n) for k, n in numeral_table().items() if "〇" not in k and "零" not in k}


def spelled() -> dict[str, str]:
    """Numbers from 1 to 99 as an age is written, with 两 for two."""
    unit = dict(enumerate("〇一两三四五六七八九"))
    ten = lambda n: ("" if n // 10 == 1 else unit[n // 10]) + "十" + (unit[n % 10] if n % 10 else "")
    return {str(n): unit[n] if n < 10 else ten(n) for n in range(1, 100)}


# -- how a value is written ---------------------------------------------------------


def digits_fullwidth(seed: Seed) -> Column:
    wide = _variant(edit(F.lit(0), F.length(seed.text), F.translate(seed.text, _DIGITS, _WIDE)), wide=True)
    return _where(seed.text.rlike("[0-9]"), wide)


def phone_regroup(seed: Seed) -> Column:
    def of(label: Column) -> Column:
        v = label["value"]
        part = lambda sep: F.concat_ws(sep, F.substring(v, 1, 3), F.substring(v, 4, 4), F.substring(v, 8, 4))
        plain, grouped = v.rlike(r"^(?U)1\d{10}\z"), v.rlike(r"^(?U)1\d{2}[ -]\d{4}[ -]\d{4}\z")
        return _some(F.when(plain, _variant(_over(label, part(" ")))), F.when(plain, _variant(_over(label, part("-")))), F.when(grouped, _variant(_over(label, F.translate(v, " -", "")))))

    return _flat(_labels_of(seed, "PHONE"), of)


def date_restyle(seed: Seed) -> Column:
    iso, chinese = r"^(?U)(\d{4})-(\d{1,2})-(\d{1,2})\z", r"^(?U)(\d{4})年(\d{1,2})月(\d{1,2})日\z"
    spoken = r"^([〇零一二三四五六七八九]+)年([一二三四五六七八九十]+)月([一二三四五六七八九十]+)日\z"
    numeral = _lookup(numerals())

    def of(label: Column) -> Column:
        v = label["value"]
        y, m, d = (F.regexp_extract(v, iso, i) for i in (1, 2, 3))
        cy, cm, cd = (F.regexp_extract(v, chinese, i) for i in (1, 2, 3))
        number = lambda x: _ascii(x).try_cast("int").cast("string")
        two = lambda x: F.lpad(number(x), 2, "0")
        year = F.translate(F.regexp_extract(v, spoken, 1), "〇零一二三四五六七八九", "00123456789")
        sm, sd = (F.try_element_at(numeral, F.regexp_extract(v, spoken, i)) for i in (2, 3))
        as_chinese = lambda a, b, c: F.concat(a, F.lit("年"), b, F.lit("月"), c, F.lit("日"))
        told = F.when(v.rlike(iso), F.array(as_chinese(y, number(m), number(d)), F.concat_ws("/", y, m, d)))
        told = told.when(v.rlike(chinese), F.array(F.concat_ws("-", cy, two(cm), two(cd)), F.concat_ws("/", cy, number(cm), number(cd))))
        told = told.when(v.rlike(spoken), F.array_compact(F.array(as_chinese(year, sm, sd)))).otherwise(F.array().cast("array<string>"))
        return F.transform(told, lambda t: _variant(_over(label, t)))

    return _flat(_labels_of(seed, "EXACT_DATE"), of)


def id_spacing(seed: Seed) -> Column:
    v = lambda label: label["value"]
    whole = F.filter(_labels_of(seed, "GOVERNMENT_ID"), lambda x: v(x).rlike(r"^(?U)\d{17}[\dXx]\z"))
    return F.transform(whole, lambda x: _variant(_over(x, F.concat_ws(" ", F.substring(v(x), 1, 6), F.substring(v(x), 7, 8), F.substring(v(x), 15, 4)))))


# -- what stands around a value ------------------------------------------------------


def _first_pair(seed: Seed, pairs: Iterable[tuple[str, str]], fits: Callable[[Column], Column]) -> Column:
    return _one(F.filter(_pairs(pairs), fits), lambda p: _some(_variant(_replace_first(seed.text, p["source"], p["target"]))))


def _no_value(seed: Seed) -> Callable[[Column], Column]:
    return lambda p: F.contains(seed.text, p["source"]) & ~F.array_contains(_values(seed), p["source"])


def label_alias(seed: Seed) -> Column:
    return _first_pair(seed, ALIASES, _no_value(seed))


def separator_swap(seed: Seed) -> Column:
    head = lambda x: F.substring(seed.text, F.lit(1), x["start"])
    last = lambda x: F.substring(seed.text, x["start"], F.lit(1))
    close = lambda x: F.instr(F.substring(seed.text, x["start"] + 1, F.length(seed.text)), "）")
    labelled = lambda x: F.exists(F.array(*map(F.lit, LABELS)), lambda label: F.endswith(head(x), label))
    open_ = lambda x: last(x) == "（"
    able = F.filter(seed.labels, lambda x: (x["start"] > 0) & (last(x).isin(*SEPARATORS) | F.when(open_(x), close(x) > 0).otherwise(labelled(x))))

    def of(x: Column) -> Column:
        before = edit(x["start"] - 1, x["start"], "")
        swaps = F.filter(F.array(*map(F.lit, SEPARATORS)), lambda s: s != last(x))
        swapped = F.transform(swaps, lambda s: _variant(before.withField("text", s)))
        added = F.transform(F.array(*map(F.lit, SEPARATORS[:3])), lambda s: _variant(edit(x["start"], x["start"], s)))
        behind = edit(x["end"], x["start"] + close(x), "")
        opened = F.transform(F.array(F.lit("："), F.lit("")), lambda s: _variant(before.withField("text", s), behind))
        return F.when(open_(x), opened).when(last(x).isin(*SEPARATORS), swapped).otherwise(added)

    return _one(able, of)


def label_drop(seed: Seed) -> Column:
    leads = F.array(*(F.lit(label + sep) for label in LABELS for sep in (*SEPARATORS, "")))
    found = F.transform(
        F.filter(seed.labels, lambda x: ~x["type"].isin(*ROLES)),
        lambda x: F.struct(x["start"].alias("at"), F.get(F.filter(leads, lambda lead: F.endswith(F.substring(seed.text, F.lit(1), x["start"]), lead)), F.lit(0)).alias("lead")),
    )
    return _one(F.filter(found, lambda x: x["lead"].isNotNull()), lambda x: _some(_variant(edit(x["at"] - F.length(x["lead"]), x["at"], ""))))


def value_split_ws(seed: Seed) -> Column:
    point = _lookup({k: str(v) for k, v in SPLIT_AT.items()})
    at = lambda x: F.try_element_at(point, x["type"]).cast("int")
    able = F.filter(seed.labels, lambda x: at(x).isNotNull() & x["value"].rlike(r"^(?U)[\dA-Za-z-]+\z") & (F.length(x["value"]) > at(x)))
    return _one(able, lambda x: _some(*(_variant(edit(x["start"] + at(x), x["start"] + at(x), gap)) for gap in (" ", "\n"))))


# -- how the sentence goes -----------------------------------------------------------


def anchor_verb_swap(seed: Seed) -> Column:
    named = F.size(_labels_of(seed, "PERSON_NAME", *ROLES)) > 0
    return F.when(named, _first_pair(seed, VERBS, _no_value(seed))).otherwise(_some())


def sex_style_swap(seed: Seed) -> Column:
    beside = lambda x: (F.substring(seed.text, x["end"] + 1, F.lit(1)) == "，") | ((x["start"] > 0) & (F.substring(seed.text, x["start"], F.lit(1)) == "，"))
    able = F.filter(_labels_of(seed, "SEX"), lambda x: x["value"].isin("男", "女") & beside(x))
    return _one(able, lambda x: _some(_variant(_over(x, F.concat(x["value"], F.lit("性"))))))


def age_numeral_swap(seed: Seed) -> Column:
    def other(x: Column) -> Column:
        digits, words = (F.regexp_extract(x["value"], p, 1) for p in (r"^(?U)(\d+)岁\z", r"^([一二三四五六七八九十两]+)岁\z"))
        return F.coalesce(F.try_element_at(_lookup(spelled()), _ascii(digits).try_cast("int").cast("string")), F.try_element_at(_lookup(numerals()), words))

    able = F.filter(_labels_of(seed, "AGE"), lambda x: other(x).isNotNull())
    return _one(able, lambda x: _some(_variant(_over(x, F.concat(other(x), F.lit("岁"))))))


def time_opener_swap(seed: Seed) -> Column:
    fits = lambda p: F.startswith(seed.text, p["source"]) | F.contains(seed.text, F.concat(F.lit("，"), p["source"])) | F.contains(seed.text, F.concat(p["source"], F.lit("，")))
    return _first_pair(seed, OPENERS, fits)


# -- what must stay as it is ---------------------------------------------------------


def population_age_swap(seed: Seed) -> Column:
    aged = F.filter(seed.clean, lambda c: c.rlike(r"(?U)([一二三四五六七八九十]+|\d+)岁"))

    def of(item: Column) -> Column:
        token = F.regexp_extract(item, r"(?U)([一二三四五六七八九十]+|\d+)岁", 0)
        digits = _ascii(F.regexp_extract(token, r"(?U)^(\d+)岁", 1)).try_cast("int")
        words = F.try_element_at(_lookup(numerals()), F.regexp_extract(token, "^([一二三四五六七八九十]+)岁", 1)).cast("int")
        spell = lambda n: F.try_element_at(_lookup(spelled()), n.cast("string"))
        restyled = F.coalesce(spell(digits), words.cast("string"))
        shifted = F.when(digits.isNotNull(), (digits + 10).cast("string")).otherwise(spell(words + 10))
        year = lambda n: F.concat(n, F.lit("岁"))
        both = F.filter(F.array(year(restyled), year(shifted)), lambda t: t.isNotNull() & (t != token))
        return F.transform(both, lambda t: _variant(_replace_first(seed.text, token, t), swap=(token, t), unlabelled=True))

    phrases = F.filter(_pairs(POPULATIONS), lambda p: F.contains(seed.text, p["source"]))
    phrased = _one(phrases, lambda p: _some(_variant(_replace_first(seed.text, p["source"], p["target"]), swap=(p["source"], p["target"]), unlabelled=True)))
    return F.when(seed.verdict == "ALLOW", F.concat(_one(aged, of), phrased)).otherwise(_some())


def referral_style_swap(seed: Seed) -> Column:
    asked = (seed.verdict == "ALLOW") & F.contains(seed.text, F.lit("会诊")) & F.contains(seed.text, F.lit("建议"))
    return _where(asked, *(_variant(_replace_first(seed.text, F.lit(a), b), swap=(a, b), unlabelled=True) for a, b in REFERRALS))


def generic_reference_swap(seed: Seed) -> Column:
    found = F.filter(_pairs(GENERICS), lambda p: (seed.verdict == "ALLOW") & F.contains(seed.text, p["source"]))
    return F.transform(found, lambda p: _variant(_replace_first(seed.text, p["source"], p["target"]), swap=(p["source"], p["target"]), unlabelled=True))


# -- what comes in addition ----------------------------------------------------------


def splice_filler(seed: Seed) -> Column:
    fresh = F.filter(F.array(*map(F.lit, FILLERS)), lambda f: ~F.contains(seed.text, f))
    end = F.length(seed.text)
    add = lambda f: _some(F.when(F.size(f) > 0, _variant(edit(end, end, F.get(f, F.lit(0))))), F.when(F.size(f) > 1, _variant(edit(F.lit(0), F.lit(0), F.get(f, F.lit(1))))))
    return let(fresh, add)


def splice_second_patient(seed: Seed) -> Column:
    there = [F.contains(seed.text, F.lit(v)) for _, v in SECOND_LABELS]
    end = F.length(seed.text)
    return _where((seed.verdict == "SANITIZE") & ~there[0] & ~there[1], _variant(edit(end, end, SECOND_PATIENT), extra=SECOND_LABELS))


#: name -> (class, the variants that it proposes)
OPERATORS: dict[str, tuple[str, Callable[[Seed], Column]]] = {
    f.__name__: (kind, f)
    for kind, fs in {
        "format": (digits_fullwidth, phone_regroup, date_restyle, id_spacing),
        "label": (label_alias, separator_swap, label_drop, value_split_ws),
        "narrative": (anchor_verb_swap, sex_style_swap, age_numeral_swap, time_opener_swap),
        "context": (population_age_swap, referral_style_swap, generic_reference_swap),
        "noise": (splice_filler, splice_second_patient),
    }.items()
    for f in fs
}


def occurrences(text: Column, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.size(F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)) - 1).otherwise(0)


def variants(seeds: DataFrame, operators: Iterable[str] | None = None, exclude_mutated: bool = False) -> DataFrame:
    """All variants of ``seeds`` (doc_id, text, labels array<struct<type,start,end>>, clean array<string>, verdict).

    Columns: doc_id ``seed__operator_n``, mutated_from, operator, operator_class, text, labels (type,
    start, end, value), clean, expected_verdict, refused.  ``refused`` says why a variant cannot be judged:
    ``seed`` (a label's value is not in the seed exactly once), ``empty`` (nothing changed),
    ``ambiguous`` (a label's value is not in the variant exactly once), ``overlap`` (a clean
    value is a label's); null if it can.  A seed whose ``mutated_from`` is set is left out on demand.
    Null texts, labels and clean values count as empty.
    """
    if exclude_mutated and "mutated_from" in seeds.columns:
        seeds = seeds.where("mutated_from is null")
    wanted = [n for n in OPERATORS if operators is None or n in set(operators)]
    text = F.coalesce("text", F.lit(""))
    labels = F.transform(F.coalesce("labels", F.array().cast("array<struct<type:string,start:int,end:int>>")), lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("value")))
    rows = seeds.select(F.col("doc_id").cast("string").alias("mutated_from"), text.alias("__seed"), labels.cast(f"array<{SPAN}>").alias("__labels"), F.coalesce("clean", F.array().cast("array<string>")).alias("__clean"), F.col("verdict").alias("expected_verdict"))
    seed = Seed(F.col("__seed"), F.col("__labels"), F.col("__clean"), F.coalesce("expected_verdict", F.lit("")))
    proposed = F.array(*(F.struct(F.lit(n).alias("operator"), F.lit(OPERATORS[n][0]).alias("operator_class"), OPERATORS[n][1](seed).alias("proposed")) for n in wanted))
    rows = rows.select("*", F.inline(proposed)).select("*", F.posexplode("proposed").alias("n", "v")).drop("proposed")
    rows = with_fenced(rows, text=apply(F.col("__seed"), F.col("v.edits")))
    moved = F.when(F.col("v.unlabelled"), F.array().cast(f"array<{SPAN}>")).otherwise(move_spans(F.col("__labels"), F.col("v.edits"), F.col("text")))
    place = lambda value: F.instr(F.col("text"), value) - 1
    extra = F.transform("v.extra", lambda x: F.struct(x["type"].alias("type"), place(x["value"]).alias("start"), (place(x["value"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))
    swapped = lambda c: F.when((F.col("v.source") != "") & F.contains(c, F.col("v.source")), apply(c, script(_replace_first(c, F.col("v.source"), F.col("v.target"))))).otherwise(c)
    clean = F.transform("__clean", lambda c: F.when(F.col("v.wide"), F.translate(c, _DIGITS, _WIDE)).otherwise(swapped(c)))
    rows = with_fenced(rows, labels=F.concat(moved, extra.cast(f"array<{SPAN}>")), clean=clean)
    unclear = lambda spans, t: F.exists(spans, lambda x: occurrences(F.col(t), x["value"]) != 1)
    refused = (
        F.when(unclear("__labels", "__seed"), "seed").when(F.col("text") == F.col("__seed"), "empty").when(unclear("labels", "text"), "ambiguous")
        .when(F.arrays_overlap(F.transform("labels", lambda x: x["value"]), F.col("clean")), "overlap")
    )
    name = F.concat(F.col("mutated_from"), F.lit("__"), F.col("operator"), F.lit("_"), (F.col("n") + 1).cast("string"))
    return rows.select(name.alias("doc_id"), "mutated_from", "operator", "operator_class", "text", "labels", "clean", "expected_verdict", refused.alias("refused"))
