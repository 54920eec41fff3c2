"""Spans of regular expressions as arrays of structs, in code points, without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "struct<type:string,start:int,end:int,confidence:double,source:string,value:string,read_only:boolean,ord:int>"
FACTS = f"array<{FACT}>"

#: Types that speak of the whole document; in a merge they yield to any other.
DOCUMENT_LEVEL = ("MEDICAL_CONTENT", "PARSER_FAILURE", "UNSUPPORTED_FORMAT")


#: Control characters that stand before, inside and behind a match.
MARKS = "\x01\x02\x03"


def EMPTY_FACTS() -> Column:  # noqa: N802
    """A typed array without facts."""
    return F.array().cast(FACTS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value taken once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, worked out once for each row, as the output of a generator.

    Filters on these columns stay above it, where they would otherwise be rewritten
    in terms of the inputs and repeat the whole chain of expressions; filters on
    columns of ``df`` go below it, down to the scan.  Each column leaves the generator
    under a name of its own: a field taken above it would be pruned into its input.
    """
    names = [f"__fenced_{k}" for k in columns]
    rows = df.select("*", F.inline_outer(F.array(F.struct(*(v.alias(n) for n, v in zip(names, columns.values()))))))
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *(F.col(n).alias(k) for n, k in zip(names, columns)))


def empty(kind: str = FACTS) -> Column:
    return F.array().cast(kind)


def mark(text: Column, head: str, value: str, tail: str = "", flags: str = "Ud") -> Column:
    """The text with marks around head, value and tail of every match, from one pass of the expression.

    Control characters cannot be in an admitted text, so they serve as marks.
    """
    return F.regexp_replace(text, f"(?{flags})(?<h>{head})(?<v>{value})(?<t>{tail})", "\x01${h}\x02${v}\x03${t}")


def read_marks(marked: Column) -> Column:
    """array<struct<start:int,value:string>> of a marked text; places are running sums of the pieces."""
    none = F.array().cast("array<struct<start:int,value:string>>")

    def step(acc: Column, piece: Column) -> Column:
        lead = F.substring_index(piece, "\x02", 1)
        rest = F.substring_index(piece, "\x02", -1)
        found = F.struct((acc["at"] + F.length(lead)).cast("int").alias("start"), F.substring_index(rest, "\x03", 1).alias("value"))
        return F.struct((acc["at"] + F.length(piece) - 2).alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def fold(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("out"))
        return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda a: a["out"])).otherwise(none)

    return let(F.split(marked, "\x01"), fold)


def spans(text: Column, head: str, value: str, tail: str = "", flags: str = "Ud") -> Column:
    """array<struct<start:int,value:string>> of what ``value`` matches in head-value-tail."""
    return read_marks(mark(text, head, value, tail, flags))


def merge(facts: Column) -> Column:
    """Order facts by place and let overlapping ones compete: a left fold against the last one kept.

    A fact that overlaps the last kept one takes its place if it outranks it
    (speaks of a span rather than the document, then confidence, then length),
    and goes otherwise.
    """
    length = lambda f: f["end"] - f["start"]
    ordered = F.array_sort(F.transform(facts, lambda f: F.struct(f["start"].alias("a"), (-length(f)).alias("b"), f["confidence"].alias("c"), f["type"].alias("d"), f["ord"].alias("e"), f.alias("f"))))
    ordered = F.transform(ordered, lambda x: x["f"])
    rank = lambda f: F.struct((~f["type"].isin(*DOCUMENT_LEVEL)).cast("int").alias("a"), f["confidence"].alias("b"), length(f).alias("c"))

    def step(kept: Column, f: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when((F.size(kept) == 0) | (f["start"] >= F.get(kept, F.size(kept) - 1)["end"]), F.concat(kept, F.array(f)))
            .when(rank(f) > rank(last), F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(f)))
            .otherwise(kept)
        )

    return let(ordered, lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), step))


def strip_invisible(text: Column) -> Column:
    from hushframe.lexicon import INVISIBLE

    return F.regexp_replace(text, f"[{INVISIBLE}]+", "")


def is_placeholder(value: Column) -> Column:
    return F.trim(value).rlike(r"^\[[A-Z][A-Z0-9_]*\]$")
