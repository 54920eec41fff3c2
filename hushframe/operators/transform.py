"""Rewriting of texts by plan: remove, mask, tokenize, shift dates, generalise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.edits import apply
from hushframe.functions.spans import let
from hushframe.operators.detect import _number, _numeral, parse_date

# What replaces a value.
REDACTED = "[REDACTED]"
MARKERS = {"PRECISE_LOCATION": "[LOCATION_GENERALIZED]", "HOSPITAL_NAME": "[INSTITUTION_GENERALIZED]", "DEPARTMENT": "[DEPARTMENT_GENERALIZED]", "WARD": "[WARD_GENERALIZED]"}

EVIDENCE = "array<struct<type:string,op:string,start:int,end:int,out_start:int,out_end:int,value:string,replacement:string>>"


def shift_days(text: Column) -> Column:
    """The day offset of a text: -365 to 364 from its hash, with 365 for 0."""
    seed = F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(730)) - 365
    return F.when(seed == 0, 365).otherwise(seed).cast("int")


def shifted_date(value: Column, days: Column) -> Column:
    day = F.date_add(parse_date(value), days)
    sep = F.when(F.contains(value, F.lit("/")), "/").otherwise("-")
    cn = F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.day(day), F.lit("日"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(F.contains(value, F.lit("年")), cn).otherwise(F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), sep, two(F.month(day)), sep, two(F.day(day))))


def month_of_date(value: Column) -> Column:
    plain = F.translate(value, "０１２３４５６７８９－／．", "0123456789-/.")
    day = parse_date(value)
    sep = F.regexp_extract(plain, r"^[0-9]{4}([-/.])", 1)
    sep = F.when(sep == "", "-").otherwise(sep)
    return F.when(F.contains(plain, F.lit("年")), F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"))).otherwise(F.concat(F.year(day).cast("string"), sep, F.lpad(F.month(day).cast("string"), 2, "0")))


def age_band(value: Column) -> Column:
    """The decade of an age in years, written in digits or numerals, or the band of an age in months; null if it is none."""
    months = value.rlike(r"(?U)^\d{1,2}\s*个?月(?:龄|大)?$")
    years = F.coalesce(_number(value), _numeral(F.regexp_extract(value, "^([一二两三四五六七八九十]+)", 1)))
    decade = (F.floor(years / 10) * 10).cast("int")
    band = F.when(years < 1, "不足1岁").when(years < 10, "1-9岁").when(years < 90, F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string"), F.lit("岁"))).when(years <= 200, "90岁及以上")
    return F.when(months, F.when(_number(value) < 12, "不足1岁").when(_number(value) <= 36, "1-9岁")).otherwise(band)


def generalized(type_: Column, value: Column) -> Column:
    out = F.when(type_ == "AGE", age_band(value)).when(type_ == "EXACT_DATE", month_of_date(value)).when(type_ == "AGE_90_PLUS", "90岁及以上")
    for name, marker in MARKERS.items():
        out = out.when(type_ == name, marker)
    return out


def token_text(type_: Column, number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("["), type_, F.lit("_"), F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0")), F.lit("]"))


def tokens(facts: Column, plan: Column) -> Column:
    """Distinct (type, value) that get a token, in order of plan operation, then of text; a token's number is its place."""
    per = F.transform(
        F.filter(plan, lambda o: o["op"] == "TOKENIZE"),
        lambda o: F.transform(F.filter(facts, lambda f: (f["type"] == o["target"]) & ~f["read_only"]), lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value"))),
    )
    return F.array_distinct(F.flatten(per))


@dataclass(frozen=True)
class Operation:
    """A way to rewrite a value, and how its result is told to be right.

    ``rewrite`` gets the fact, the number of its token and the day offset of its text;
    ``holds`` the evidence row and that offset, and derives the result from the value alone.
    ``erases``: whether no fact of the type may be left where the operation was.
    """

    name: str
    rewrite: Callable[[Column, Column, Column], Column]
    holds: Callable[[Column, Column], Column]
    erases: bool = False


def _date_moved(e: Column, own: Column) -> Column:
    days = F.datediff(parse_date(e["replacement"]), parse_date(e["value"]))
    return (days == own) & (days != 0)


_BUILT_IN = (
    Operation("REMOVE", lambda f, n, d: F.lit(REDACTED), lambda e, d: e["replacement"] == REDACTED, erases=True),
    Operation("MASK", lambda f, n, d: F.repeat(F.lit("*"), F.greatest(F.length(f["value"]), F.lit(1))), lambda e, d: e["replacement"].rlike("^[*]+$") & (F.length(e["replacement"]) == F.greatest(F.length(e["value"]), F.lit(1))), erases=True),
    Operation("TOKENIZE", lambda f, n, d: token_text(f["type"], n), lambda e, d: F.regexp_replace(e["replacement"], "_[0-9]{3,}\\]$", "") == F.concat(F.lit("["), e["type"]), erases=True),
    Operation("DATE_SHIFT", lambda f, n, d: shifted_date(f["value"], d), _date_moved),
    Operation("GENERALIZE", lambda f, n, d: generalized(f["type"], f["value"]), lambda e, d: (e["replacement"] == generalized(e["type"], e["value"])) & (e["replacement"] != e["value"])),
)
#: The operations that plans may name; ``register`` adds to them.
OPERATIONS: dict[str, Operation] = {o.name: o for o in _BUILT_IN}


def register(operation: Operation) -> None:
    """Let profiles and plans name an operation; it is used and checked by every plan built from now on."""
    if operation.name in OPERATIONS or operation.name == "BLOCK":
        raise ValueError(f"operation {operation.name!r} is there already")
    OPERATIONS[operation.name] = operation


def unregister(name: str) -> None:
    """Take back what ``register`` added."""
    if name in {o.name for o in _BUILT_IN}:
        raise ValueError(f"operation {name!r} is built in")
    OPERATIONS.pop(name, None)


def erasing() -> tuple[str, ...]:
    return tuple(o.name for o in OPERATIONS.values() if o.erases)


def evidence(text: Column, facts: Column, plan: Column, numbers: Column | None = None) -> Column:
    """What is replaced, in order of place, with places in the input and in the output.

    ``numbers``, an array of struct<type,value,number>, numbers the tokens of texts that
    share them; without it each text counts its own.
    """
    by_type = F.map_from_entries(F.transform(plan, lambda o: F.struct(o["target"], o["op"])))

    def of(known: Column, days: Column, ops: Column) -> Column:
        def replacement(f: Column) -> Column:
            op = F.try_element_at(ops, f["type"])
            own = F.struct(f["type"].alias("type"), f["value"].alias("value"))
            place = F.array_position(known, own) if numbers is None else F.try_element_at(known, own)
            first, *others = (o for o in OPERATIONS.values())
            out = F.when(op == first.name, first.rewrite(f, place, days))
            for o in others:
                out = out.when(op == o.name, o.rewrite(f, place, days))
            return out

        used = F.filter(facts, lambda f: ~f["read_only"] & F.try_element_at(ops, f["type"]).isNotNull())
        rows = F.transform(used, lambda f: F.struct(f["type"].alias("type"), F.try_element_at(ops, f["type"]).alias("op"), f["start"].alias("start"), f["end"].alias("end"), f["value"].alias("value"), replacement(f).alias("replacement")))
        start = F.struct(F.lit(0).alias("delta"), F.array().cast(EVIDENCE).alias("out"))

        def step(acc: Column, r: Column) -> Column:
            at = r["start"] + acc["delta"]
            row = F.struct(r["type"].alias("type"), r["op"].alias("op"), r["start"].alias("start"), r["end"].alias("end"), at.alias("out_start"), (at + F.length(r["replacement"])).alias("out_end"), r["value"].alias("value"), r["replacement"].alias("replacement"))
            return F.struct((acc["delta"] + F.length(r["replacement"]) - (r["end"] - r["start"])).alias("delta"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.aggregate(rows, start, step, lambda a: a["out"])

    known = tokens(facts, plan) if numbers is None else F.map_from_entries(F.transform(numbers, lambda n: F.struct(F.struct(n["type"].alias("type"), n["value"].alias("value")), n["number"])))
    return let(F.struct(known.alias("known"), shift_days(text).alias("days"), by_type.alias("ops")), lambda x: of(x["known"], x["days"], x["ops"]))


def splice(text: Column, done: Column) -> Column:
    """The text with every evidence row's span replaced; null if any replacement is null."""
    edits = F.transform(done, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("text")))
    return F.when(~F.exists(done, lambda e: e["replacement"].isNull()), apply(text, edits))
