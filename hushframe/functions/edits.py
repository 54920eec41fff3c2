"""Edit scripts over a text: arrays of replacements that do not overlap, and the places that they move.

A script is ``array<struct<start,end,text>>`` in order, with places in code points of the
text before it.  A span keeps what it covers: what is inserted at its start moves it, what
is inserted at its end stays outside, and what is replaced inside becomes part of it.  Places
inside a replacement of equal length stay where they are, so a rewriting of the whole text
letter by letter is one edit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT = "struct<start:int,end:int,text:string>"
SCRIPT = f"array<{EDIT}>"
SPAN = "struct<type:string,start:int,end:int,value:string>"


def edit(start: Column, end: Column, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


def script(*edits: Column) -> Column:
    return F.array(*edits).cast(SCRIPT)


def apply(text: Column, edits: Column) -> Column:
    """The text behind the script: the pieces between the edits, and what stands in their places."""
    last = F.coalesce(F.get(edits, F.size(edits) - 1)["end"], F.lit(0))

    def piece(e: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(edits, i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, before + 1, e["start"] - before), e["text"])

    return F.concat(F.array_join(F.transform(edits, piece), ""), F.substring(text, last + 1, F.length(text)))


def _growth(e: Column) -> Column:
    return F.length(e["text"]) - (e["end"] - e["start"])


def _moved(place: Column, edits: Column, before) -> Column:
    return F.aggregate(edits, place.cast("int"), lambda at, e: at + F.when(before(e), _growth(e)).otherwise(0))


def moved_start(place: Column, edits: Column) -> Column:
    return _moved(place, edits, lambda e: e["end"] <= place)


def moved_end(place: Column, edits: Column) -> Column:
    return _moved(place, edits, lambda e: (e["end"] <= place) & (e["start"] < place))


def move_spans(spans: Column, edits: Column, after: Column) -> Column:
    """Spans (type, start, end) at their places in the text ``after`` the script, with what they cover there."""

    def move(s: Column) -> Column:
        start, end = moved_start(s["start"], edits), moved_end(s["end"], edits)
        return F.struct(s["type"].alias("type"), start.alias("start"), end.alias("end"), F.substring(after, start + 1, end - start).alias("value"))

    return F.transform(spans, move).cast(f"array<{SPAN}>")


def inverse(text: Column, edits: Column) -> Column:
    """The script that leads back."""

    def back(e: Column) -> Column:
        start = _moved(e["start"], edits, lambda o: o["end"] <= e["start"])
        return edit(start, start + F.length(e["text"]), F.substring(text, e["start"] + 1, e["end"] - e["start"]))

    return F.transform(edits, back).cast(SCRIPT)
