"""evaluate() and sanitize(): the lifecycle of a payload as narrow projections over a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.spans import EMPTY_FACTS, strip_invisible, with_fenced
from hushframe.operators.detect import detect, facts_of, with_facts
from hushframe.operators.transform import EVIDENCE, evidence, splice
from hushframe.operators.verify import verify, with_read_only
from hushframe.plans.policy import PROFILES, Profile, closed_decision, coerce_purpose, coerce_trust, decide, granted_plan
from hushframe.sources.admission import is_binary

#: Columns that evaluate() and sanitize() add; the input may not have them.
ADDED = ("facts", "decision", "sanitized", "verification", "released", "decision_after")


def _column(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def evaluate(df: DataFrame, text: str = "text", recipient: str | Column = "EXTERNAL_APPROVED", purpose: str | Column = "EXTERNAL_AI_ASSISTANCE", profile: Profile | str = "external-ai-strict", detectors: Iterable[str] | None = None, extra: Iterable[Column | Callable[[Column], Column]] = ()) -> DataFrame:
    """``df`` with the text stripped of invisible characters, its ``facts`` and the ``decision``.

    Null texts and binary ones are closed: BLOCK, CRITICAL, 100.  ``extra`` are custom
    detectors and dictionaries: functions from a text column to facts, which also look
    at the rewritten text in sanitize(), or facts of the text that are there already.
    """
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    trust, why = coerce_trust(_column(recipient)), coerce_purpose(_column(purpose))
    readable = F.col(text).isNotNull() & ~is_binary(F.col(text))
    clean = df.withColumn("__ok", F.coalesce(readable, F.lit(False))).withColumn(text, F.when(F.col("__ok"), strip_invisible(F.col(text))).otherwise(F.col(text)))
    more = [e if isinstance(e, Column) else e(F.col("__text")) for e in extra]
    found = with_facts(clean.withColumn("__text", F.when(F.col("__ok"), F.col(text)).otherwise("")), "__text", "facts", detectors, more)
    decided = with_fenced(found, decision=F.when(F.col("__ok"), decide(F.col("facts"), trust, why, profile)).otherwise(closed_decision(profile)))
    return decided.drop("__ok", "__text")


def approved(rows: DataFrame, accepted: Column, profile: Profile) -> tuple[DataFrame, Column]:
    """The rows with the plans of approved ASKs, and the condition of what is rewritten."""
    granted = (F.col("decision.verdict") == "ASK") & accepted.isNotNull()
    plan = F.when(granted, granted_plan(F.col("facts"), profile)).otherwise(F.col("decision.plan"))
    return rows.withColumn("decision", F.col("decision").withField("plan", plan)), (F.col("decision.verdict") == "SANITIZE") | granted


def sanitize(df: DataFrame, text: str = "text", recipient: str | Column = "EXTERNAL_APPROVED", purpose: str | Column = "EXTERNAL_AI_ASSISTANCE", profile: Profile | str = "external-ai-strict", detectors: Iterable[str] | None = None, extra: Iterable[Column | Callable[[Column], Column]] = (), accepted: Column | None = None) -> DataFrame:
    """evaluate(), then the plan applied and verified.

    ``sanitized`` is the released text and null where nothing is released: ALLOW
    releases the stripped input, SANITIZE the rewritten text if ``verification``
    passed, ASK and BLOCK nothing.  ``verification`` is null where it did not run.

    ``accepted`` is not null where a checked and consumed grant approves the row: the types
    whose risk it accepts in values that cannot be rewritten.  An approved ASK is rewritten
    and verified like SANITIZE; an approval opens nothing else.
    """
    profile = PROFILES[profile] if isinstance(profile, str) else profile
    trust, why = coerce_trust(_column(recipient)), coerce_purpose(_column(purpose))
    named = tuple(detectors) if detectors is not None else None
    work = F.col("decision.verdict") == "SANITIZE"
    rows = evaluate(df, text, recipient, purpose, profile, detectors, extra)
    if accepted is not None:
        rows, work = approved(rows, accepted, profile)
    rows = rows.withColumn("__done", F.when(work, evidence(F.col(text), F.col("facts"), F.col("decision.plan"))).otherwise(F.array().cast(EVIDENCE)))
    rows = with_fenced(rows, __out=F.when(work, splice(F.col(text), F.col("__done"))))
    again = [e(F.col("__out")) for e in extra if not isinstance(e, Column)]
    residual = detect(F.col("__out"), named, again) if again else facts_of("__out", named)
    rows = with_fenced(rows, __residual=F.when(work, residual).otherwise(EMPTY_FACTS()))
    if accepted is not None:
        rows = rows.withColumn("__residual", with_read_only(F.col("__residual"), F.col("facts"), F.col("__done"), accepted))
    listed = F.filter("__residual", lambda f: F.startswith(f["source"], F.lit("dictionary.")) & (f["source"] != "dictionary.department"))
    checked = verify(F.col(text), F.col("facts"), F.col("__done"), F.col("__out"), F.col("__residual"), trust, why, profile, dictionary_hits=listed, accepted=accepted)
    rows = with_fenced(rows, verification=F.when(work, checked))
    passed = F.coalesce(F.col("verification.passed"), F.lit(False))
    after = F.when(work & passed, decide(F.col("__residual"), trust, why, profile))
    out = F.when(F.col("decision.verdict") == "ALLOW", F.col(text)).when(work & passed, F.col("__out"))
    rows = with_fenced(rows, released=(F.col("decision.verdict") == "ALLOW") | (work & passed), sanitized=out, decision_after=after)
    return rows.drop("__done", "__out", "__residual")
