"""Institution dictionary: terms as a checked source, hits as facts."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import lexicon as L
from hushframe.functions.spans import FACTS, empty, spans

# What a term of a category is reported as.
CATEGORY_TYPES = {"institution": "HOSPITAL_NAME", "department": "DEPARTMENT", "ward": "WARD", "staff": "DOCTOR_NAME"}


def load(path: str) -> list[tuple[str, str]]:
    """(term, category) of a CSV file with the header category,name, or of a JSON object of string arrays."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        tree = json.loads(text)
        if not isinstance(tree, dict) or any(not isinstance(v, list) for v in tree.values()):
            raise ValueError("dictionary: an object of string arrays is needed")
        pairs = [(c, t) for c, names in tree.items() for t in names]
    else:
        rows = [r for r in csv.reader(text.splitlines()) if r and not r[0].lstrip().startswith("#")]
        if not rows or [c.strip() for c in rows[0]] != ["category", "name"] or any(len(r) != 2 for r in rows):
            raise ValueError("dictionary: rows of category,name are needed")
        pairs = [(r[0].strip(), r[1]) for r in rows[1:]]
    if any(c not in CATEGORY_TYPES or not isinstance(t, str) or not t.strip() for c, t in pairs):
        raise ValueError("dictionary: unknown category or empty term")
    if len({(c, t.strip()) for c, t in pairs}) < len(pairs):
        raise ValueError("dictionary: a term is listed twice in its category")
    return sorted({(t.strip(), c) for c, t in pairs}, key=lambda x: (-len(x[0]), x[0], x[1]))


def dictionary_facts(text: Column, terms: Iterable[tuple[str, str]]) -> Column:
    """Facts of literal terms, longest first, unless a word of referral stands before one.

    One alternation per dictionary: the longest term wins where several begin.
    """
    import re

    listed = sorted(set(terms), key=lambda x: (-len(x[0]), x[0], x[1]))
    if not listed:
        return empty()
    quoted = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", t) for t, _ in listed)
    pairs = ", ".join(f"{json.dumps(t, ensure_ascii=False)}, '{c}'" for t, c in dict((t, c) for t, c in reversed(listed)).items())
    category = F.expr(f"map({pairs})")
    types = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in CATEGORY_TYPES.items()) + ")")
    found = spans(text, f"(?<!{L.REFERRAL})", quoted)

    def fact(s: Column) -> Column:
        c = F.try_element_at(category, s["value"])
        return F.struct(
            F.try_element_at(types, c).alias("type"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).cast("int").alias("end"), F.lit(0.97).alias("confidence"),
            F.concat(F.lit("dictionary."), c).alias("source"), s["value"].alias("value"), F.lit(False).alias("read_only"), F.lit(1000).alias("ord"),
        )

    return F.transform(found, fact).cast(FACTS)
