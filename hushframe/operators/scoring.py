"""Detection scored against labels: one-to-one alignment, rates, percentiles and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.operators.intervals import inside, untouched_by
from hushframe.operators.terms import occurrences

KEY = ["doc_id", "type", "start", "end"]


def align(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, type, start, end, outcome): tp, fp or fn; duplicates match one to one."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(1)))
    a = facts.select(*KEY, nth.alias("nth")).withColumn("found", F.lit(True))
    b = labels.select(*KEY, nth.alias("nth")).withColumn("labelled", F.lit(True))
    both = a.join(b, [*KEY, "nth"], "full_outer")
    outcome = F.when(F.col("found") & F.col("labelled"), "tp").when(F.col("found"), "fp").otherwise("fn")
    return both.select(*KEY, outcome.alias("outcome"))


def rates(aligned: DataFrame, *by: str) -> DataFrame:
    """(by, tp, fp, fn, recall, precision, over_redaction); rates have 4 digits, recall and precision are 1 where nothing counts."""
    n = lambda x: F.sum(F.when(F.col("outcome") == x, 1).otherwise(0))
    out = aligned.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    ratio = lambda a, b, none: F.round(F.when(b > 0, a / b).otherwise(F.lit(none)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"recall": ratio(tp, tp + fn, 1.0), "precision": ratio(tp, tp + fp, 1.0), "over_redaction": ratio(fp, tp + fp, 0.0)})


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, p50, p95) by nearest rank."""
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*by).agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def covered(labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Labels that lie inside a fact of their type in the same document."""
    return inside(labels, facts, ["doc_id", "type"])


def untouched(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """Spans that no fact of their document overlaps."""
    return untouched_by(probes, facts, ["doc_id"])


def gates(totals: DataFrame, least_recall: float = 1.0, least_precision: float = 1.0) -> DataFrame:
    """``totals`` with the names of failed gates, in order, and whether all passed."""
    failed = F.array_compact(F.array(F.when(F.col("recall") < least_recall, "recall"), F.when(F.col("precision") < least_precision, "precision"), F.when(F.col("fp") > 0, "false_positives")))
    return totals.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


# Fields of an audit record that are random and no payload's.
RANDOM_FIELDS = ("event_id", "prev_hash", "event_hash")


def leaked_values(audit_text: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_leaked): distinct label values of two characters or more that occur in audit texts (column text), their random fields aside."""
    plain = audit_text.select(F.regexp_replace("text", rf'"(?:{"|".join(RANDOM_FIELDS)})"\s*:\s*"[^"]*"', "").alias("text"))
    values = labels.select("value").where("length(value) >= 2")
    return occurrences(plain, values, term="value", each=False).distinct().agg(F.count("*").alias("n_leaked"))


# -- what survives a release ----------------------------------------------------

# What stands around a value that is only part of a longer number or band.
FRAGMENT_BEFORE = "0-9.\\-–—~～"
BAND_SUFFIXES = ("及以上", "及以下", "以上", "以下", "左右", "上下")
BAND_PREFIX = "不足"


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def survives(value: Column, released: Column) -> Column:
    """Whether a value stands in a released text by itself, not as a piece of a number or of a generalised band."""
    before, after = f"(?<![{FRAGMENT_BEFORE}])(?<!{BAND_PREFIX})", f"(?![0-9]|{'|'.join(BAND_SUFFIXES)})"
    return F.rlike(released, F.concat(F.lit(before), _quoted(value), F.lit(after)))


def still_present(value: Column, released: Column) -> Column:
    """Whether a value is left in a released text; an age in years not as the end of a band."""
    years = F.regexp_extract(value, "^([0-9]{1,3})岁$", 1)
    return F.when(years != "", F.rlike(released, F.concat(F.lit("(?<![-0-9])"), years, F.lit("岁")))).otherwise(F.contains(released, value))


#: What an audit of a document may have failed by.
AUDIT_FAILURES = ("missing", "invalid", "mismatch", "read_error")


def totals_by(outcomes: DataFrame, *by: str) -> DataFrame:
    """Measures of scored documents for each group, or over all.

    ``outcomes`` has a row for each document: tp, fp, fn, labelled_spans, residual_spans,
    released, allowed_original, sanitized_verified, verification_ran, verification_failed,
    lifecycle_failed, audit_failure (one of AUDIT_FAILURES or null), error (null if there was none),
    actual_verdict and expected_verdict.  Missing values count as nothing, a missing verdict as a mismatch.
    """
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(1.0))
    tp, fp, fn = n("tp"), n("fp"), n("fn")
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("documents"), n("labelled_spans = 0").alias("clean_documents"), (tp + fn).alias("labelled_spans"), fn.alias("false_negatives"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"),
        fp.alias("false_positives"), n("case when labelled_spans = 0 then fp end").alias("false_positives_on_clean_documents"), n("residual_spans").alias("residual"), n("released").alias("released_documents"),
        n("allowed_original").alias("allowed_original_documents"), n("sanitized_verified").alias("sanitized_verified_documents"), n("actual_verdict = 'ASK'").alias("ask_documents"), n("actual_verdict = 'BLOCK'").alias("blocked_documents"),
        n("verification_ran").alias("verification_runs"), n("verification_failed").alias("verification_failures"), n("lifecycle_failed").alias("lifecycle_failures"), n("audit_failure is not null").alias("audit_failures"),
        *(n(f"audit_failure = '{x}'").alias(f"audit_{x}") for x in AUDIT_FAILURES), n("error is not null").alias("errors"),
        n("not (actual_verdict <=> expected_verdict)").alias("verdict_mismatch"), n("actual_verdict = 'ALLOW' and not (expected_verdict <=> 'ALLOW')").alias("false_allow"),
    )


# The gates of a run in the order in which failures are told, and when each fails.
GATES = (
    ("false_allow", "false_allow > 0"),
    ("residual_phi", "residual > 0"),
    ("audit_raw_leak", "audit_leaks > 0"),
    ("errors", "errors > 0"),
    ("verification_failure", "verification_failures > 0"),
    ("lifecycle_failure", "lifecycle_failures > 0"),
    ("audit_failure", "audit_failures > 0"),
    ("incomplete_span_coverage", "false_negatives > 0"),
    ("sanitize_path_not_exercised", "sanitized_verified_documents = 0 or verification_runs = 0"),
    ("verdict_mismatch", "verdict_mismatch > 0"),
    ("false_positive", "false_positives > 0"),
)


def all_gates(totals: DataFrame, leaks: DataFrame | None = None) -> DataFrame:
    """totals_by() with ``audit_leaks``, the names of all failed gates in order, and whether all passed.

    ``leaks`` is the one row of leaked_values(); without it the audit counts as free of them.
    """
    told = totals.withColumn("audit_leaks", F.lit(0).cast("long")) if leaks is None else totals.crossJoin(F.broadcast(leaks.select(F.col("n_leaked").cast("long").alias("audit_leaks"))))
    failed = F.array_compact(F.array(*(F.when(F.expr(test), name) for name, test in GATES)))
    return told.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def simulation(cases: DataFrame) -> DataFrame:
    """One row over (released text or null, phi, clean): values that a release still holds, and clean ones that it lost.

    A case that is withheld neither misses nor loses anything, but its values count in the rates.
    """
    out = F.col("released").isNotNull()
    missed = F.when(out, F.size(F.filter("phi", lambda v: still_present(v, F.col("released"))))).otherwise(0)
    lost = F.when(out, F.size(F.filter("clean", lambda v: ~F.contains(F.col("released"), v)))).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = cases.agg(F.count("*").alias("documents"), total(F.size("phi")).alias("labelled_values"), total(F.size("clean")).alias("kept_values"), total(missed).alias("missed"), total(lost).alias("over_redacted"), total((~out)).alias("withheld_documents"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return one.withColumns({"miss_rate": share("missed", "labelled_values"), "over_redaction_rate": share("over_redacted", "kept_values")})


def in_order(counts: DataFrame, order: list[str], name: str = "name") -> DataFrame:
    """Rows with known names first, in the given order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name))
    return counts.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), name)
