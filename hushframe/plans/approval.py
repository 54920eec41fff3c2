"""Requests that a person has to approve: what they ask for, which grants hold, and their release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.rows import settled
from hushframe.functions.spans import empty
from hushframe.operators import grants
from hushframe.plans.policy import CONTEXT_ONLY, coerce_purpose, coerce_trust, types_of

USED_UP = "grant has expired, been revoked, or has already been used"


def asked(rows: DataFrame, key: bytes, content: str = "content", kind: str | Column = "text", recipient: str = "EXTERNAL_APPROVED", purpose: str = "EXTERNAL_AI_ASSISTANCE", recipient_name: str = "", endpoint: str = "") -> DataFrame:
    """Evaluated ``rows`` with the ``fingerprint`` and ``untransformable_types`` of those that ask, null for others.

    The fingerprint binds content, kind, recipient, purpose, policy, verdict, reasons and types: a grant is for nothing else.
    """
    asks = F.col("decision.verdict") == "ASK"
    kind = F.lit(kind) if isinstance(kind, str) else kind
    print_ = grants.fingerprint(
        key, F.sha2(content, 256), kind, coerce_trust(F.lit(recipient)), F.lit(recipient_name), F.lit(endpoint), coerce_purpose(F.lit(purpose)),
        F.col("decision.policy_version"), F.col("decision.verdict"), F.col("decision.reason_codes"), types_of(F.col("facts")),
    )
    fixed = F.array_sort(types_of(F.filter("facts", lambda f: f["read_only"] & ~f["type"].isin(*CONTEXT_ONLY))))
    return rows.withColumns({"fingerprint": F.when(asks, print_), "untransformable_types": F.when(asks, fixed)})


def approve(fields: DataFrame, held: DataFrame, consumed: DataFrame, revocations: DataFrame, now: Column, request: str = "request_id", field: str = "field_no") -> DataFrame:
    """(request, field, accepted, problem) of the fields that ask.

    ``fields`` are rows of asked() with their request and place; ``held`` the grants with
    ``signature_valid``; ``consumed`` (grant_key, uses_consumed).  The fields are evaluated
    once: their slim rows are kept, and all that follows reads those.
    All fields of a request are judged before a use is taken: one that is blocked, or asks
    without a sound grant, leaves every grant of its request as it was.  A use that was
    taken is not given back.  ``accepted`` is null unless all that the request asks is granted.
    """
    fields = settled(fields.select(request, field, F.col("decision.verdict").alias("verdict"), "fingerprint", "untransformable_types"))
    asks = fields.where("fingerprint is not null").drop("verdict")
    checked = grants.check(asks, held, now)
    closed = fields.groupBy(request).agg(F.bool_or(F.col("verdict") == "BLOCK").alias("closed"))
    unsound = checked.groupBy(request).agg(F.bool_or(F.col("problem").isNotNull()).alias("unsound"))
    judged = checked.join(closed.join(unsound, request).selectExpr(request, "closed or unsound AS stopped"), request)
    seq = F.struct(request, field)
    attempts = judged.where("not stopped").select(F.col("grant_id").alias("grant_key"), seq.alias("seq"), now.alias("at"))
    uses = held.select(F.col("grant_id").alias("grant_key"), "uses_allowed", "expires_at").join(consumed, "grant_key", "left").withColumn("uses_consumed", F.coalesce("uses_consumed", F.lit(0)))
    taken = grants.consume(attempts, uses, revocations).select(F.col(f"seq.{request}").alias(request), F.col(f"seq.{field}").alias(field), "consumed")
    told = judged.join(taken, [request, field], "left")
    why = F.coalesce("problem", F.when(F.col("stopped"), "another field of the request is withheld").when(~F.coalesce("consumed", F.lit(False)), USED_UP))
    told = told.withColumn("why", why)
    whole = told.groupBy(request).agg(F.bool_and(F.col("why").isNull()).alias("whole"))
    accepted = F.when(F.col("whole"), F.coalesce("accepted_types", empty("array<string>")))
    return told.join(whole, request).select(request, field, accepted.alias("accepted"), F.col("why").alias("problem"))
