"""Scoped approvals: fingerprints, checks, use budgets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.hashes import hmac_sha256
from hushframe.operators.audit import _json_text


def _listed(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(x), _json_text), ", "), F.lit("]"))


def fingerprint(key: bytes, content_hash: Column, payload_kind: Column, trust: Column, recipient_name: Column, endpoint: Column, purpose: Column, policy_version: Column, verdict: Column, reasons: Column, types: Column) -> Column:
    """HMAC over what is disclosed to whom and why, as JSON with sorted keys."""
    none = lambda c: F.coalesce(c, F.lit(""))
    parts = {
        "content_hash": _json_text(content_hash), "fact_types": _listed(types), "payload_kind": _json_text(payload_kind), "policy_version": _json_text(policy_version), "purpose": _json_text(purpose),
        "reason_codes": _listed(reasons), "recipient_endpoint": _json_text(none(endpoint)), "recipient_name": _json_text(none(recipient_name)), "recipient_trust": _json_text(trust), "verdict": _json_text(verdict),
    }
    body = [F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(parts.items())]
    return hmac_sha256(F.concat(F.lit("{"), F.array_join(F.array(*body), ", "), F.lit("}")), key)


#: Fields of a grant that its signature covers.
SIGNED = "grant_id string, request_fingerprint string, issuer string, issued_at string, expires_at string, uses_allowed int, accepted_types array<string>"


def _signed_text() -> Column:
    """The signed fields as JSON with sorted keys and no spaces."""
    texts = ("expires_at", "grant_id", "issued_at", "issuer", "request_fingerprint")
    value = {n: _json_text(F.col(n)) for n in texts} | {"uses_allowed": F.col("uses_allowed").cast("string"), "accepted_types": F.concat(F.lit("["), F.array_join(F.transform("accepted_types", _json_text), ","), F.lit("]"))}
    return F.concat(F.lit("{"), F.array_join(F.array(*(F.concat(F.lit(f'"{n}":'), value[n]) for n in sorted(value))), ","), F.lit("}"))


def issue(requests: DataFrame, key: bytes, issuer: str, now: Column, ttl_seconds: int, uses_allowed: int = 1) -> DataFrame:
    """Signed grants for (fingerprint, accepted_types): each for one fingerprint, from now for a bounded time and number of uses."""
    if not 0 < ttl_seconds <= 365 * 86_400 or uses_allowed < 1 or not issuer:
        raise ValueError("a grant needs an issuer, a bounded time to live and a use at least")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ends = now + F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = requests.select(
        hmac_sha256(F.concat_ws("|", "fingerprint", iso(now), F.lit(issuer)), key).alias("grant_id"), F.col("fingerprint").alias("request_fingerprint"), F.lit(issuer).alias("issuer"),
        iso(now).alias("issued_at"), iso(ends).alias("expires_at"), F.lit(uses_allowed).alias("uses_allowed"), F.array_sort("accepted_types").alias("accepted_types"),
    )
    return rows.withColumn("signature", hmac_sha256(_signed_text(), key))


def with_validity(grants: DataFrame, key: bytes) -> DataFrame:
    """``grants`` with ``signature_valid`` and their times as timestamps; a changed field or another key makes it false."""
    told = grants.withColumn("signature_valid", F.coalesce(hmac_sha256(_signed_text(), key) == F.col("signature"), F.lit(False)))
    at = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return told.withColumn("issued_at", at(F.col("issued_at"))).withColumn("expires_at", at(F.col("expires_at")))


def check(requests: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """``requests`` with ``problem``: why the grant for its fingerprint does not hold, or null.

    Requests have fingerprint and untransformable_types; grants have
    request_fingerprint, signature_valid, issued_at, expires_at (timestamps) and
    accepted_types.  Several grants for one fingerprint are refused: none of them is taken.
    """
    same = Window.partitionBy("request_fingerprint")
    told = grants.withColumn("__copies", F.count("*").over(same)).withColumn("__nth", F.row_number().over(same.orderBy("issued_at"))).where("__nth = 1").drop("__nth")
    both = requests.join(told.withColumnRenamed("request_fingerprint", "fingerprint"), "fingerprint", "left")
    missing = F.array_sort(F.array_except("untransformable_types", F.coalesce("accepted_types", F.array().cast("array<string>"))))
    problem = (
        F.when(F.col("issued_at").isNull() & F.col("signature_valid").isNull(), "no grant")
        .when(F.col("__copies") > 1, "more than one grant for the request")
        .when(~F.coalesce("signature_valid", F.lit(False)), "grant signature does not verify")
        .when(F.col("issued_at").isNull() | F.col("expires_at").isNull(), "grant timestamps are malformed")
        .when(F.col("issued_at") > now, "grant is not yet valid")
        .when(F.col("expires_at") <= now, "grant has expired")
        .when(F.size(missing) > 0, F.concat(F.lit("grant does not accept the risk of: "), F.array_join(missing, ", ")))
    )
    return both.withColumn("problem", problem).drop("__copies")


def statuses(uses: DataFrame, revocations: DataFrame, now: Column) -> DataFrame:
    """(grant_key, uses_allowed, uses_consumed, expires_at, status): revoked before expired before exhausted before active.

    Keys that were revoked without ever being used have null counts.
    """
    gone = revocations.select("grant_key").distinct().withColumn("revoked", F.lit(True))
    rows = uses.join(gone, "grant_key", "full_outer")
    status = F.when(F.col("revoked"), "revoked").when(F.col("expires_at") <= now, "expired").when(F.col("uses_consumed") >= F.col("uses_allowed"), "exhausted").otherwise("active")
    return rows.select("grant_key", "uses_allowed", "uses_consumed", "expires_at", status.alias("status"))


def summary(told: DataFrame) -> DataFrame:
    """(status, grants, uses_allowed, uses_consumed, uses_left) of statuses(); keys that were only revoked count as grants without uses."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    left = F.when(F.col("status") == "active", F.greatest(F.col("uses_allowed") - F.col("uses_consumed"), F.lit(0)))
    return told.groupBy("status").agg(F.count("*").alias("grants"), total(F.col("uses_allowed")).alias("uses_allowed"), total(F.col("uses_consumed")).alias("uses_consumed"), total(left).alias("uses_left"))


def consume(attempts: DataFrame, uses: DataFrame, revocations: DataFrame) -> DataFrame:
    """(grant_key, seq, consumed): which of the attempts (grant_key, seq, at) get one of the grant's uses.

    Attempts are taken in order of seq for each key; revoked keys and attempts at
    or after the expiry get none, and a use is never given back.
    """
    live = attempts.join(revocations.select("grant_key").distinct(), "grant_key", "left_anti").join(uses, "grant_key").where("at < expires_at")
    nth = F.row_number().over(Window.partitionBy("grant_key").orderBy("seq"))
    used = live.withColumn("nth", nth).where(F.col("nth") + F.col("uses_consumed") <= F.col("uses_allowed")).select("grant_key", "seq", F.lit(True).alias("consumed"))
    return attempts.join(used, ["grant_key", "seq"], "left").select("grant_key", "seq", F.coalesce("consumed", F.lit(False)).alias("consumed"))
