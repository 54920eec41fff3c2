"""Detectors as a table of rules; one Column of facts per text.

A rule is head-value-tail of one regular expression with a type, a confidence and
a source, and at most a check of what was found.  All of it is built-in
expressions: detection is a narrow projection without shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import lexicon as L
from hushframe.functions.spans import FACTS, MARKS, empty, is_placeholder, let, mark, merge, read_marks, with_fenced

_SEP = r"[ \t\x{3000}]*[:：=]?[ \t\x{3000}]*"
_SEP_NEEDED = r"(?:[ \t\x{3000}]*[:：=][ \t\x{3000}]*|[ \t\x{3000}]+)"
_OPEN, _CLOSE = "[（(]?", "[）)]?"
_SURNAME, _GIVEN = f"[{L.SURNAMES}]", f"[{L.GIVEN}]{{1,2}}"
_COMPOUND = f"(?:{L.COMPOUND_SURNAMES})"
_HAN = r"[\x{4e00}-\x{9fff}]"
#: Surname and given name from the inventories.
_KNOWN_NAME = f"(?:{_COMPOUND}{_GIVEN}|{_SURNAME}{_GIVEN}|{_SURNAME}[一二三四五六七八九十])"
_LOOSE_NAME = f"(?:{_COMPOUND}[{L.NAME_MARKS}]{{0,2}}?|{_SURNAME}[{L.NAME_MARKS}]{{0,2}}?)"
_NAME_END = rf"(?=[，,。；;、\s{L.INVISIBLE}\x{{2e2f}}）)】\]（(【\[]|$|(?:{L.AFTER_NAME}))"
_TOKEN_END = r"(?![A-Za-z0-9_\-])"


@dataclass(frozen=True)
class Rule:
    detector: str
    type: str
    confidence: float
    source: str
    head: str
    value: str
    tail: str = ""
    flags: str = "Ud"
    check: str = ""  # a name of CHECKS
    fold: bool = False  # full-width digits and date marks become ASCII first
    anchor: str = ""  # a cheap expression without which nothing can match


def _field(labels: str, value: str) -> tuple[str, str]:
    return f"(?:{labels}){_SEP}{_OPEN}", value


def _number(v: Column) -> Column:
    """The number of up to three digits, of either width, that a text begins with."""
    return F.regexp_extract(F.translate(v, "０１２３４５６７８９", "0123456789"), "^([0-9]{1,3})", 1).try_cast("int")


def numeral_table() -> dict[str, int]:
    """Chinese numerals of up to three characters that are read as a number, by rule."""
    unit = {c: i for i, c in enumerate(L.NUMERALS)} | {"两": 2}
    heads = {"": 1} | {c: i for c, i in unit.items() if i}
    return unit | {h + "十" + t: a * 10 + b for h, a in heads.items() for t, b in ({"": 0} | unit).items()}


def _numeral(token: Column) -> Column:
    table = ", ".join(f"'{k}', {v}" for k, v in numeral_table().items())
    return F.try_element_at(F.expr(f"map({table})"), token)


def parse_date(v: Column) -> Column:
    """The date that a text of any accepted spelling names, or null; years 1900 to 2099."""
    plain = F.translate(v, "０１２３４５６７８９－／．", "0123456789-/.")
    ymd = F.regexp_replace(F.regexp_replace(plain, "[年月./]", "-"), "日$", "")
    american = F.regexp_replace(plain, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2")
    numeral = r"^([〇零一二三四五六七八九]{4})年([一二三四五六七八九十]{1,3})月([一二三四五六七八九十]{1,3})日$"
    part = lambda i: F.regexp_extract(v, numeral, i)
    cn = F.concat_ws("-", F.translate(part(1), "〇零一二三四五六七八九", "00123456789"), _numeral(part(2)).cast("string"), _numeral(part(3)).cast("string"))
    text = F.when(v.rlike(numeral), cn).when(plain.rlike("^[0-9]{1,2}/"), american).otherwise(ymd)
    day = F.when(text.rlike("^(19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "y-M-d"))
    return day


def valid_id(v: Column) -> Column:
    """GB 11643: eighteen characters of which the last fits the weighted sum of the others modulo 11."""
    plain = F.translate(v, "０１２３４５６７８９", "0123456789")
    digits = F.transform(F.split(F.substring(plain, 1, 17), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    weights = F.expr(f"array({', '.join(map(str, L.ID_WEIGHTS))})")
    total = F.aggregate(F.zip_with(digits, weights, lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0), lambda a, b: a + b)
    expected = F.substring(F.lit(L.ID_CHECK), (total % 11).cast("int") + 1, F.lit(1))
    return (F.length(v) == 18) & plain.rlike("^[0-9]{17}") & (F.upper(F.substring(v, 18, 1)) == expected)


_Y, _M, _D = "(?:19[0-9]{2}|20[0-9]{2})", "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
_D0, _D1 = r"(?<!\d)(?<!\d[-/.])", r"(?!\d)(?![-/.]\d)"
_departments = "|".join(sorted(L.DEPARTMENTS, key=lambda x: (-len(x), x)))
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_phone = "[0-9０-９]"
_gap = r"(?:[ \x{00a0}\x{3000}]+|[-－])"
_mail = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"

_BRACKET = r"[（(【\[]?"


def _either(*words: str) -> str:
    """One of the words."""
    return f"(?:{'|'.join(words)})"


def _not_behind(*words: str) -> str:
    """None of the words or patterns ends here."""
    return "".join(f"(?<!{w})" for w in sorted(words))


def _not_before(*words: str) -> str:
    """None of the words begins here."""
    return f"(?!{'|'.join(sorted(words))})" if words else ""


def _names_behind(detector: str, kind: str, sure: float, titles: str, anchor: str, apart: str = "", joined: str = "", repeated: bool = False) -> list[Rule]:
    """Names behind a title.

    Where something parts the two, any name up to an end counts; right behind the title only
    one of the inventories.  A title may be repeated before the name.
    """
    title = _either(titles)
    parted = title + _SEP_NEEDED + (f"{title}?" if repeated else "") + _BRACKET
    return [
        Rule(detector, kind, sure, f"regex.{detector}{apart}", parted, _LOOSE_NAME, _NAME_END, anchor=anchor),
        Rule(detector, kind, sure, f"regex.{detector}{joined}", title, _KNOWN_NAME, anchor=anchor),
    ]


def _names_before(detector: str, kind: str, titles: tuple[str, ...], longer: tuple[str, ...], given: str) -> Rule:
    """A surname and at most two further characters right before a title that no longer title holds."""
    surname = _either(_COMPOUND, _SURNAME)
    return Rule(detector, kind, 0.8, f"regex.{detector}", _not_behind(*longer), f"{surname}[{given}]{{0,2}}?", _either(*titles), anchor="|".join(titles))


def _ages() -> list[Rule]:
    """Ages of one person: in years by digits or numerals, unless of a group, and in months behind a child or a label, or grown so old."""
    years = rf"\s*{_either(*L.AGE_UNITS)}"
    of_a_group = f"(?:{L.POPULATION_LEAD})"
    digits = Rule("age", "AGE", 0.95, "regex.age", _not_behind(r"[\d.\-–—~～]", L.AGE_LESS_THAN, of_a_group), rf"\d{{1,3}}{years}", _not_before(*L.AGE_GROUP_ENDS), check="years", anchor="岁")
    numerals = "一二两三四五六七八九十"
    spelled = Rule("age", "AGE", 0.95, "regex.age.numeral", _not_behind(rf"[\d{numerals}]", of_a_group), rf"[{numerals}]{{1,3}}{years}", _not_before(*L.AGE_GROUP_ENDS, *L.AGE_ERA_ENDS), check="numeral_years", anchor="岁")
    count = rf"\d{{1,2}}\s*{_either(*sorted(L.MONTH_UNITS, key=len, reverse=True))}"
    child = rf"{_either(*L.MONTH_SUBJECTS)}\s*"
    label = rf"{_either(*L.MONTH_LABELS)}\s*[:：=]?\s*"
    told = Rule("age", "AGE", 0.95, "regex.age.month", _either(child, label), f"{count}{_either(*L.MONTH_ENDS)}?", check="months", anchor="月")
    grown = Rule("age", "AGE", 0.95, "regex.age.month", "", rf"\d{{1,2}}\s*{L.MONTH_UNITS[1]}{L.MONTH_ENDS[1]}", check="months", anchor="月")
    return [digits, told, grown, spelled]


def _sexes() -> list[Rule]:
    """A sex behind its label or a patient, before an age, or as what a patient is."""
    short, long = _either(*L.SEXES), _either(*(x + L.SEX_SUFFIX for x in L.SEXES), *L.SEXES)
    pause = "，,、"
    contexts = (
        (f"{L.SEX_LABEL}{_SEP}", short, ""),
        (rf"{_either(*L.SEX_SUBJECTS)}[\s{pause}]*", long, rf"(?=[{pause}。；;\s)\d]|$)"),
        (_not_behind(_HAN), short, rf"\s*[{pause}]\s*\d{{1,3}}\s*{_either(*L.AGE_UNITS)}"),
        ("", short, f"{L.SEX_SUFFIX}(?={'|'.join(L.SEX_NOUNS)})"),
    )
    return [Rule("sex", "SEX", 0.9, "regex.sex", before, value, behind, anchor="|".join(L.SEXES)) for before, value, behind in contexts]


RULES: tuple[Rule, ...] = (
    Rule("cn_phone", "PHONE", 1.0, "regex.cn_phone", r"(?<!\d)", rf"[1１][3-9３-９]{_phone}(?:{_phone}{{8}}|{_gap}{_phone}{{4}}{_gap}{_phone}{{4}})", r"(?!\d)", anchor=rf"[1１][3-9３-９]{_phone}(?:{_phone}|[ \x{{00a0}}\x{{3000}}－-])"),
    Rule("cn_id18", "GOVERNMENT_ID", 1.0, "regex.cn_id18", r"(?<!\d)", r"(?:\d[ \n]?){17}[\dXx]", r"(?!\d)", check="id18", anchor=r"\d[ \n]?\d[ \n]?\d[ \n]?\d[ \n]?\d"),
    Rule("email", "EMAIL", 1.0, "regex.email", "(?<![A-Za-z0-9._%+-])", rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@{_mail}(?:\.{_mail})+", "(?![A-Za-z0-9._%+-])", anchor="@"),
    Rule("url", "URL", 1.0, "regex.url", "", r"https?://[^\s<>'\"，。；;]+", flags="Udiu", anchor="://"),
    Rule("ipv4", "IP_ADDRESS", 1.0, "regex.ipv4", r"(?<![\d.])", rf"{_octet}(?:\.{_octet}){{3}}", r"(?![\d.])", anchor=r"\d\.\d"),
    Rule("exact_date", "EXACT_DATE", 1.0, "regex.exact_date.numeral", "", "[〇零一二三四五六七八九]{4}年[一二三四五六七八九十]{1,3}月[一二三四五六七八九十]{1,3}日", check="date", anchor="年"),
    Rule("exact_date", "EXACT_DATE", 1.0, "regex.exact_date", _D0, rf"{_Y}(?<sep>[-/.]){_M}\k<sep>{_D}", _D1, check="date", fold=True, anchor="(?:19|20)[0-9]{2}[-/.]"),
    Rule("exact_date", "EXACT_DATE", 1.0, "regex.exact_date", _D0, f"{_M}/{_D}/{_Y}", _D1, check="date", fold=True, anchor="/(?:19|20)[0-9]{2}"),
    Rule("exact_date", "EXACT_DATE", 1.0, "regex.exact_date", _D0, f"{_Y}年{_M}月{_D}日", _D1, check="date", fold=True, anchor="年"),
    Rule("landline", "LANDLINE", 0.9, "regex.landline", r"(?<!\d)", rf"[0０]{_phone}{{2,3}}[-－\s]?{_phone}{{7,8}}", r"(?!\d)", anchor=r"[0０][0-9０-９]{2,3}[-－\s]?[0-9０-９]{7}"),
    Rule("person_field", "PERSON_NAME", 0.95, "regex.person_field", f"(?:{L.PATIENT_LABELS})(?:{_SEP_NEEDED}|(?=[（(])){_OPEN}", f"[{L.NAME_MARKS}]{{2,20}}?", rf"(?=\s*[）)]|(?:{L.PATIENT_NEXT_FIELDS})\s*[:：]?|[,，。；;\s{L.INVISIBLE}\x{{2e2f}}]|(?:{L.AFTER_NAME})|$)", anchor=L.PATIENT_LABELS),
    Rule("person_field", "PERSON_NAME", 0.95, "regex.person_field", f"(?:{L.PATIENT_LABELS})", _KNOWN_NAME, rf"(?=[,，。；;、\s{L.INVISIBLE}\x{{2e2f}}]|$|(?:{L.AFTER_NAME}))", anchor=L.PATIENT_LABELS),
    Rule("person_field", "PERSON_NAME", 0.95, "regex.person_field", r"\b(?:patient|patient's name|name)\b(?:\s*:\s*|\s+)", r"[A-Za-z][A-Za-z'\-]*(?:\s+[A-Za-z][A-Za-z'\-]*){0,5}", r"(?=[,;\n\r]|$)", flags="Udiu", anchor="(?i)patient|name"),
    Rule("medical_record_field", "MEDICAL_RECORD_NUMBER", 0.95, "regex.medical_record_field", *_field(L.RECORD_LABELS, r"[A-Za-z0-9０-９](?:[A-Za-z0-9０-９_\-]|[ \n](?=[A-Za-z0-9０-９])){2,63}"), rf"{_CLOSE}(?![A-Za-z0-9０-９_\-])", anchor=L.RECORD_LABELS),
    Rule("medical_record_field", "MEDICAL_RECORD_NUMBER", 0.95, "regex.medical_record_field", rf"\b(?:mrn|admission\s*id|visit\s*id|medical\s*record\s*number|medical\s*record(?!\s*number\b))\b{_SEP}", r"[A-Za-z0-9][A-Za-z0-9_\-]{2,63}", _TOKEN_END, flags="Udiu", anchor="(?i)mrn|admission|visit|medical"),
    Rule("precise_location_field", "PRECISE_LOCATION", 0.95, "regex.precise_location_field", f"(?:{L.ADDRESS_LABELS}){_SEP}", r"[^\n\r,，。；;]{4,100}", r"(?=[\n\r,，。；;]|$)", check="no_placeholder", anchor=L.ADDRESS_LABELS),
    Rule("precise_location_field", "PRECISE_LOCATION", 0.95, "regex.precise_location_field.verb", rf"(?:{L.ADDRESS_VERBS})\s*[:：]?\s*", rf"[\x{{4e00}}-\x{{9fff}}\d]{{2,30}}(?:{L.ADDRESS_ENDS})", anchor="住|户籍|籍贯"),
    Rule("specimen_id", "SPECIMEN_ID", 0.9, "regex.specimen_id", *_field(L.SPECIMEN_LABELS, r"[A-Za-z0-9][A-Za-z0-9_\-]{1,31}"), _CLOSE + _TOKEN_END, anchor="本"),
    Rule("accession_number", "ACCESSION_NUMBER", 0.9, "regex.accession_number", *_field(L.ACCESSION_LABELS, r"[A-Za-z0-9][A-Za-z0-9_\-]{1,31}"), _CLOSE + _TOKEN_END, anchor="号"),
    Rule("postal_code", "POSTAL_CODE", 0.9, "regex.postal_code", *_field(L.POSTAL_LABELS, r"\d{6}"), _CLOSE + r"(?!\d)", anchor="邮|postal"),
    Rule("social_media_id", "SOCIAL_MEDIA_ID", 0.9, "regex.social_media_id", *_field(L.SOCIAL_LABELS, r"[A-Za-z0-9][A-Za-z0-9_\-]{4,31}"), _CLOSE + _TOKEN_END, anchor="微信|QQ|企鹅号"),
    Rule("hospital_name", "HOSPITAL_NAME", 0.85, "regex.hospital_name", "", f"{_HAN}{{2,12}}?(?:{'|'.join(L.HOSPITAL_ENDS)})", check="institution", anchor="医|卫生院"),
    Rule("department", "DEPARTMENT", 0.9, "dictionary.department", "", f"(?:(?<=(?:{L.DEPARTMENT_LABELS})[ \\t\\x{{3000}}]{{0,7}}[:：=]?[ \\t\\x{{3000}}]{{0,7}}[（(]?)|(?<=(?:{L.DEPARTMENT_MOVES})\\s{{0,8}}))(?:{_departments})|(?:{_departments})(?={L.DEPARTMENT_NEXT})", anchor="科|门诊部|住院部|手术室|导管室|中心"),
    Rule("ward", "WARD", 0.85, "regex.ward", rf"(?<!{_HAN})(?!(?:{'|'.join(sorted(L.WARD_GENERIC, key=len, reverse=True))})病区)", f"{_HAN}{{1,4}}病区", anchor="病区"),
    Rule("ward", "WARD", 0.85, "regex.ward", r"(?<![\dA-Za-z])", rf"(?:{_HAN}{{0,6}}?)?(?:\d{{1,2}}|[一二三四五六七八九十]{{1,2}})病区", anchor="病区"),
    Rule("bed_number", "BED_NUMBER", 0.9, "regex.bed_number", "(?<![A-Za-z0-9])", r"[A-Z]?\d{1,3}\s*床", "(?!位)", anchor="床"),
    Rule("bed_number", "BED_NUMBER", 0.9, "regex.bed_number.label", *_field(L.BED_LABELS, r"[A-Z]?\d{1,3}"), _CLOSE + r"(?!\d)", anchor="床"),
    _names_before("doctor_name", "DOCTOR_NAME", L.DOCTOR_SHORT_TITLES, L.DOCTOR_TITLE_STARTS, L.NAME_MARKS),
    *_names_behind("doctor_name", "DOCTOR_NAME", 0.8, L.DOCTOR_TITLES, "医|大夫|助|签名", apart=".title", joined=".title_adjacent"),
    _names_before("nurse_name", "NURSE_NAME", L.NURSE_SHORT_TITLES, L.NURSE_TITLE_STARTS, r"\x{3400}-\x{9fff}"),
    *_names_behind("nurse_name", "NURSE_NAME", 0.8, L.NURSE_TITLES, "护"),
    *_names_behind("relative_name", "RELATIVE_NAME", 0.75, L.RELATIVES, L.RELATIVES, repeated=True),
    *_ages(),
    *_sexes(),
    Rule("rare_context", "RARE_CONTEXT", 0.7, "regex.rare_context", "", "本(?:县|市|区|地区|省)唯一", anchor="唯一"),
    Rule("rare_context", "RARE_CONTEXT", 0.7, "regex.rare_context", "", "全(?:国|省|市|县|区)唯一", anchor="唯一"),
    Rule("rare_context", "RARE_CONTEXT", 0.7, "regex.rare_context", rf"(?:{L.RARE_CASES})[为系是]?\s*", "(?:极|超)?罕见(?:变异(?:型病例)?|病例|疾病|病|综合征)", anchor="罕见"),
    Rule("rare_context", "RARE_CONTEXT", 0.7, "regex.rare_context", "", "世界首例|国内首例|本院首例|首例报道", anchor="首例"),
    Rule("rare_context", "RARE_CONTEXT", 0.7, "regex.rare_context", r"(?<!\d)", r"1[0-2]\d\s*岁(?:以上|高龄)", anchor="岁"),
    Rule("medical_content_baseline", "MEDICAL_CONTENT", 0.8, "regex.medical_content_baseline", "", L.MEDICAL, flags="Udiu"),
    Rule("recall_narrative_name", "PERSON_NAME", 0.6, "regex.recall_narrative_name", "", f"{_SURNAME}{_HAN}{{1,2}}", r"(?=[，,、\s（(]*(?:\d{1,3}\s*岁[，,、\s]*)?(?:男|女)(?:性)?(?:[，,）、。；;\s]|$))", anchor="男|女"),
    Rule("recall_narrative_name", "PERSON_NAME", 0.6, "regex.recall_narrative_name", "", _KNOWN_NAME, f"(?=(?:主诉|自诉|自述|诉){_HAN})", anchor="诉|自述"),
    Rule("recall_narrative_name", "PERSON_NAME", 0.6, "regex.recall_narrative_name", r"(?:(?<=[，,。；;、！？!?\s\n])|^)", f"(?:{_COMPOUND}{_GIVEN}|{_SURNAME}{_GIVEN})", f"(?=(?:因|由|以){_HAN})", anchor="因|由|以"),
)

DETECTORS: tuple[str, ...] = tuple(dict.fromkeys(r.detector for r in RULES))


_VERBS = "|".join(sorted(L.HOSPITAL_VERBS, key=lambda x: (-len(x), x)))
_ENDS = "|".join(sorted(L.HOSPITAL_ENDS, key=len, reverse=True))


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, "[ \n]", "")


#: What a found value must be, by the name that a rule gives.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "date": lambda v: parse_date(v).isNotNull(),
    "years": lambda v: _number(v).between(1, 120),
    "months": lambda v: _number(v).between(1, 36),
    "numeral_years": lambda v: _numeral(F.regexp_extract(v, "^([一二两三四五六七八九十]+)", 1)).between(1, 120),
    "no_placeholder": lambda v: ~is_placeholder(v),
    # generic qualifiers are no name
    "institution": lambda v: let(F.regexp_replace(v, f"(?:{_ENDS})$", ""), lambda stem: (stem != "") & ~stem.isin(*L.HOSPITAL_GENERIC)),
    # a plain number is reported whatever its check digit, one with gaps only if that is right
    "id18": lambda v: let(_bare(v), lambda bare: (bare == v) | valid_id(bare)),
}

_RAW = "array<struct<start:int,value:string,rule:int>>"


def _trimmed(text: Column, rules: tuple[Rule, ...]) -> Callable[[Column], Column]:
    """The value of a raw span from the text itself; institutions lose leading verbs and all up to the last function word."""
    place = {i for i, r in enumerate(rules) if r.type == "PRECISE_LOCATION"}
    names = {i for i, r in enumerate(rules) if r.check == "institution"}

    def of(s: Column) -> Column:
        whole = F.substring(text, s["start"] + 1, F.length(s["value"]))
        out = F.struct(s["start"].alias("start"), whole.alias("value"), s["rule"].alias("rule"))
        if place:
            out = F.when(s["rule"].isin(*place), F.struct(s["start"].alias("start"), F.regexp_replace(whole, r"(?U)\s+$", "").alias("value"), s["rule"].alias("rule"))).otherwise(out)
        if names:
            name = F.regexp_extract(F.regexp_replace(whole, f"^(?:{_VERBS})(?=.)", ""), f"[^{L.HOSPITAL_CUT}]*$", 0)
            cut = F.struct((s["start"] + F.length(whole) - F.length(name)).alias("start"), name.alias("value"), s["rule"].alias("rule"))
            out = F.when(s["rule"].isin(*names), cut).otherwise(out)
        return out

    return of


def _passing(rules: list[int], check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: ~s["rule"].isin(*rules) | F.coalesce(check(s["value"]), F.lit(False))


def _at_seams(pattern: str) -> str:
    """The pattern with NUL as the end and the start of a text: texts that are joined by it are read as if each were alone."""
    return pattern.replace("[^", r"[^\x00").replace("|$", r"|$|\x00").replace("|^)", r"|^|(?<=\x00))")


def needs_han(rule: Rule) -> bool:
    """Whether each alternative of the rule's anchor holds a Han character, so that nothing matches in a text without any."""
    return all(any("\u4e00" <= c <= "\u9fff" for c in part) for part in rule.anchor.split("|"))


def raw_facts(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Facts of all rules, not merged.

    Each rule marks a copy of the text in one pass, if its cheap anchor is there;
    one fold reads the marks of all copies.
    """
    folded = F.translate(text, "０１２３４５６７８９－／．", "0123456789-/.")
    marks = []
    for r in rules:
        source = folded if r.fold else text
        marked = mark(source, *map(_at_seams, (r.head, r.value, r.tail)), r.flags)
        marks.append(F.when(source.rlike(f"(?U){r.anchor}"), marked) if r.anchor else marked)
    # one look for a Han character spares the others most of the rules
    plain = [F.lit(None).cast("string") if needs_han(r) else m for r, m in zip(rules, marks)]
    copies = F.when(text.rlike(_HAN), F.array(*marks)).otherwise(F.array(*plain)) if any(map(needs_han, rules)) else F.array(*marks)
    none = F.array().cast(_RAW)
    number = lambda found, i: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["value"].alias("value"), i.alias("rule")))
    raw = F.flatten(F.transform(copies, lambda m, i: F.when(m.isNull(), none).otherwise(number(read_marks(m), i))))
    raw = F.transform(raw, _trimmed(text, rules))
    for name, check in CHECKS.items():
        own = [i for i, r in enumerate(rules) if r.check == name]
        if own:
            raw = F.filter(raw, _passing(own, check))
    told = ", ".join(f"named_struct('type', '{r.type}', 'confidence', {r.confidence}D, 'source', '{r.source}')" for r in rules)
    ids = [i for i, r in enumerate(rules) if r.check == "id18"]

    def fact(s: Column, meta: Column) -> Column:
        sure = F.when(s["rule"].isin(*ids) & ~F.coalesce(valid_id(_bare(s["value"])), F.lit(False)), F.lit(0.4)).otherwise(meta["confidence"]) if ids else meta["confidence"]
        return F.struct(
            meta["type"].alias("type"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).cast("int").alias("end"), sure.alias("confidence"),
            meta["source"].alias("source"), s["value"].alias("value"), F.lit(False).alias("read_only"), s["rule"].alias("ord"),
        )

    return F.transform(raw, lambda s: fact(s, F.get(F.expr(f"array({told})"), s["rule"]))).cast(FACTS)


def detect(text: Column, detectors: Iterable[str] | None = None, extra: Iterable[Column] = ()) -> Column:
    """Merged facts of a text; ``extra`` are further arrays of facts (custom detectors, dictionary)."""
    wanted = set(DETECTORS if detectors is None else detectors)
    rules = tuple(r for r in RULES if r.detector in wanted)
    text = F.translate(text, MARKS, "   ")  # no text can hold the marks by which matches are told
    parts = ([raw_facts(text, rules)] if rules else []) + [e.cast(FACTS) for e in extra]
    return merge(F.concat(*parts)) if parts else empty()


def with_facts(df: DataFrame, text: str = "text", name: str = "facts", detectors: Iterable[str] | None = None, extra: Iterable[Column] = ()) -> DataFrame:
    """``df`` with an array of facts; texts without any anchor character skip all rules but the cheap tests."""
    more = tuple(extra)
    if more:
        return with_fenced(df, **{name: detect(F.col(text), detectors, more)})
    return with_fenced(df, **{name: facts_of(text, None if detectors is None else tuple(detectors))})


_BUILT: dict[tuple[str, str, tuple[str, ...] | None], Column] = {}


def facts_of(text: str, detectors: tuple[str, ...] | None = None) -> Column:
    """``detect`` of a column name, built once for each session: the whole table of rules is a large expression."""
    from pyspark import SparkContext

    running = SparkContext._active_spark_context
    at = (running.applicationId if running else "", text, detectors)
    if at not in _BUILT:
        _BUILT[at] = detect(F.col(text), detectors)
    return _BUILT[at]
