"""Joins of intervals by bins, so that a document of many spans is many small groups instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of one bin; about the length of a sentence, so that a span lies in one or two.
WIDTH = 64


def _bin(place: Column, width: int) -> Column:
    return F.floor(place / width).cast("long")


def in_bins(df: DataFrame, start: str = "start", end: str = "end", width: int = WIDTH, name: str = "__bin") -> DataFrame:
    """``df`` with a row for each bin that the interval [start, end) touches; empty and null intervals touch none."""
    rows = df.where(F.col(start) < F.col(end))
    return rows.withColumn(name, F.explode(F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width))))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal ``on`` whose [start, end) overlap, each once: columns of ``left`` but ``on`` as ``l_``, of ``right`` as ``r_``.

    A pair meets in every bin that both touch and is taken in the first of them.
    """
    named = lambda df, p: df.select(*on, *(F.col(c).alias(p + c) for c in df.columns if c not in on))
    a = in_bins(named(left, "l_"), "l_start", "l_end", width)
    b = in_bins(named(right, "r_"), "r_start", "r_end", width)
    both = a.join(b, [*on, "__bin"])
    first = F.col("__bin") == _bin(F.greatest("l_start", "r_start"), width)
    return both.where(first & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))).drop("__bin")


def inside(inner: DataFrame, outer: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """The rows of ``inner`` that lie inside a row of ``outer`` with equal ``on``; each inner row stands in its first bin only."""
    a = inner.withColumn("__bin", _bin(F.col("start"), width))
    b = in_bins(outer.select(*on, F.col("start").alias("__a"), F.col("end").alias("__b")), "__a", "__b", width)
    l, r = a.alias("l"), b.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*on, "__bin"]]
    held = (F.col("r.__a") <= F.col("l.start")) & (F.col("r.__b") >= F.col("l.end"))
    condition = held
    for s in same:
        condition = condition & s
    return l.join(r, condition, "left_semi").drop("__bin")


def untouched_by(rows: DataFrame, others: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """The rows that no row of ``others`` with equal ``on`` overlaps; empty intervals are touched by none."""
    key = [*on, "start", "end"]
    touched = overlapping(rows.select(*key).distinct(), others.select(*key).distinct(), on, width).select(*on, F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct()
    return rows.join(touched, key, "left_anti").select(*rows.columns)
