"""Independent checks of a rewritten text, from its input, its evidence and a fresh detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe import lexicon as L
from hushframe.functions.spans import empty, let
from hushframe.operators.transform import OPERATIONS, erasing, shift_days
from hushframe.plans.policy import CONTEXT_ONLY, Profile, decide, types_of

NAMES = ("PERSON_NAME", "DOCTOR_NAME", "NURSE_NAME", "RELATIVE_NAME")


def names_end_well(text: Column, done: Column) -> Column:
    """False if a name is followed by a character that may still belong to it."""
    next_ = lambda e: F.substring(text, e["end"] + 1, 8)
    han = lambda e: next_(e).rlike(r"^[\x{4e00}-\x{9fff}]")
    explained = lambda e: ~next_(e).rlike(f"^[{L.GIVEN}]") & next_(e).rlike(f"^(?:{L.AFTER_NAME}|医生|医师|大夫|护士)")
    return F.forall(done, lambda e: ~e["type"].isin(*NAMES) | ~han(e) | explained(e))


def replacements_hold(text: Column, done: Column) -> Column:
    """Each operation's output, derived again from the value alone."""

    def good(e: Column, own: Column) -> Column:
        first, *others = OPERATIONS.values()
        out = F.when(e["op"] == first.name, first.holds(e, own))
        for o in others:
            out = out.when(e["op"] == o.name, o.holds(e, own))
        return F.coalesce(out, F.lit(False))

    return let(shift_days(text), lambda own: F.forall(done, lambda e: good(e, own)))


def context_untouched(text: Column, out: Column, done: Column) -> Column:
    """What lies between the replaced spans is the same on both sides, and values are what the input has there."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(True).alias("same"))

    def step(acc: Column, e: Column) -> Column:
        same = (
            acc["same"] & (e["start"] >= acc["i"]) & (F.substring(text, acc["i"] + 1, e["start"] - acc["i"]) == F.substring(out, acc["o"] + 1, e["out_start"] - acc["o"]))
            & (F.substring(text, e["start"] + 1, e["end"] - e["start"]) == e["value"]) & (F.substring(out, e["out_start"] + 1, e["out_end"] - e["out_start"]) == e["replacement"])
        )
        return F.struct(e["end"].alias("i"), e["out_end"].alias("o"), F.coalesce(same, F.lit(False)).alias("same"))

    tail = lambda a: a["same"] & (F.substring(text, a["i"] + 1, F.length(text)) == F.substring(out, a["o"] + 1, F.length(out)))
    return F.coalesce(F.aggregate(done, start, step, tail), F.lit(False))


def tokens_one_to_one(done: Column) -> Column:
    used = F.filter(done, lambda e: e["op"] == "TOKENIZE")
    pairs = F.array_distinct(F.transform(used, lambda e: F.struct(e["type"], e["value"], e["replacement"])))
    names = F.array_distinct(F.transform(used, lambda e: e["replacement"]))
    values = F.array_distinct(F.transform(used, lambda e: F.struct(e["type"], e["value"])))
    return (F.size(pairs) == F.size(names)) & (F.size(pairs) == F.size(values))


def covered_by(accepted: Column | None) -> Callable[[Column], Column]:
    """Whether a fact is of a value that cannot be rewritten and of a type whose risk was accepted; null ``accepted`` covers nothing."""
    if accepted is None:
        return lambda f: F.lit(False)  # noqa: ARG005
    return lambda f: f["read_only"] & F.coalesce(F.array_contains(accepted, f["type"]), F.lit(False))


def with_read_only(residual: Column, facts: Column, done: Column, accepted: Column) -> Column:
    """The residual with the marks of accepted read-only values, which a flat text has lost.

    Only the very span that such a value has after the replacements before it is marked.
    """
    covers = covered_by(accepted)

    def moved(f: Column) -> Column:
        by = F.aggregate(F.filter(done, lambda e: e["end"] <= f["start"]), F.lit(0), lambda acc, e: acc + (e["out_end"] - e["out_start"]) - (e["end"] - e["start"]))
        return F.struct(f["type"].alias("type"), (f["start"] + by).alias("start"), (f["end"] + by).alias("end"))

    kept = F.transform(F.filter(facts, covers), moved)
    mark = lambda known: F.transform(residual, lambda f: f.withField("read_only", f["read_only"] | F.array_contains(known, F.struct(f["type"].alias("type"), f["start"].alias("start"), f["end"].alias("end")))))
    return let(kept, mark)


def verify(text: Column, facts: Column, done: Column, out: Column, residual: Column, trust: Column, purpose: Column, profile: Profile, dictionary_hits: Column | None = None, accepted: Column | None = None) -> Column:
    """struct<passed,reason_codes,details>; the first check that fails is named.

    ``accepted`` are the types that a checked grant accepts in values that cannot be rewritten.
    """
    covers = covered_by(accepted)
    granted = F.lit(False) if accepted is None else accepted.isNotNull() & F.forall(residual, lambda f: covers(f) | f["type"].isin(*CONTEXT_ONLY))
    erase = [t for t, (a, _) in profile.identifiers.items() if a in erasing()]
    change = [t for t, (a, _) in profile.identifiers.items() if a in OPERATIONS and not OPERATIONS[a].erases]
    left = F.filter(residual, lambda f: f["type"].isin(*change) & ~covers(f))
    shifted = lambda f: F.exists(done, lambda e: (e["op"] == "DATE_SHIFT") & (e["out_start"] == f["start"]) & (e["out_end"] == f["end"]) & (e["type"] == f["type"]))
    allowed = F.forall(residual, lambda f: f["type"].isin(*change, *CONTEXT_ONLY))
    fine = lambda again: (again == "ALLOW") | ((again == "ASK") & granted) | ((again == "SANITIZE") & (F.size(residual) > 0) & allowed)
    checks = [
        ("the output is missing", out.isNotNull()),
        ("an identifier remains", ~F.exists(residual, lambda f: f["type"].isin(*erase) & ~covers(f))),
        ("a dictionary term remains", F.lit(True) if dictionary_hits is None else F.size(dictionary_hits) == 0),
        ("a new type appeared", F.size(F.array_except(types_of(residual), types_of(facts))) == 0),
        ("context changed", context_untouched(text, out, done)),
        ("a replacement is wrong", replacements_hold(text, done)),
        ("tokens are ambiguous", tokens_one_to_one(done)),
        ("a name may be cut short", names_end_well(text, done)),
        ("a value remains that should have changed", F.forall(left, shifted)),
        ("policy does not allow the output", let(decide(residual, trust, purpose, profile)["verdict"], fine)),
    ]
    detail = None
    for why, good in checks:
        bad = ~F.coalesce(good, F.lit(False))
        detail = F.when(bad, why) if detail is None else detail.when(bad, why)
    told = lambda failed: F.struct(failed.isNull().alias("passed"), F.when(failed.isNotNull(), F.array(F.lit("VERIFICATION_FAILED"))).otherwise(empty("array<string>")).alias("reason_codes"), failed.alias("details"))
    return let(detail.otherwise(F.lit(None).cast("string")), told)
