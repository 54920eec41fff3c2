"""Chat and tool-call requests: which fields are rewritten, which only judged, and what happens to the request."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.plans.records import sanitize_records
from hushframe.sources.structured import kind_of_text

#: Verdict and release -> what a sender is told; fixed values of the exit and HTTP codes.
EXIT_CODES = {"ALLOW": 0, "SANITIZE": 2, "ASK": 3, "BLOCK": 4}


def outcome(verdict: Column, released: Column) -> Column:
    """release, approval_required, verification_failed or blocked."""
    return F.when(released, "release").when(verdict == "ASK", "approval_required").when(verdict == "SANITIZE", "verification_failed").otherwise("blocked")


def exit_code(verdict: Column) -> Column:
    out = F.lit(4)
    for name, code in EXIT_CODES.items():
        out = F.when(verdict == name, code).otherwise(out)
    return out


def status_code(result: Column) -> Column:
    """HTTP status of an outcome: 200, 400 for no known shape, 422 for a failed verification, or 403 where nothing may pass."""
    return F.when(result == "release", 200).when(result == "invalid", 400).when(result == "verification_failed", 422).otherwise(403)


#: Parts that no text can be read from; a request with one is refused.
UNREADABLE = ("image", "image_url", "input_image", "document", "input_audio", "file")
_FIELD = "array<struct<path:string,mode:string,kind:string,content:string>>"


class Unknown(ValueError):
    """A body of no known shape."""


def _field(path: str, mode: str, value: object) -> dict[str, str]:
    """A text, or a container in a text or as such, as JSON; a text that is broken JSON is refused."""
    if not isinstance(value, str):
        return {"path": path, "mode": mode, "kind": "json", "content": json.dumps(value if isinstance(value, (dict, list)) else [value])}
    kind = kind_of_text(value)
    if kind == "unsupported":
        return {"path": path, "mode": "refused", "kind": None, "content": None}
    return {"path": path, "mode": mode, "kind": "json" if kind == "text" else kind, "content": json.dumps([value]) if kind == "text" else value}


def _parts(path: str, content: object) -> list[dict[str, str]]:
    if content is None:
        return []
    if isinstance(content, str):
        return [_field(path, "rewrite", content)]
    if not isinstance(content, list):
        raise Unknown(path)
    out = []
    for i, part in enumerate(content):
        at = f"{path}/{i}"
        if not isinstance(part, dict):
            raise Unknown(at)
        if part.get("type") in UNREADABLE:
            out.append({"path": at, "mode": "refused", "kind": None, "content": None})
        else:  # whatever a part carries is looked at: text, results of tools, inputs
            out += [_field(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", "rewrite", v) for k, v in part.items() if k != "type" and v is not None]
    return out


def read_fields(body: str | None) -> list[dict[str, str]]:
    """The texts of a chat request in either provider's shape.

    Message contents, system texts, arguments of tool calls and metadata are
    rewritten; user names and descriptions of tools are only judged.  A body that
    does not parse or has no messages gives one field of the mode ``invalid``.
    """
    try:
        doc = json.loads(body or "")
        if not isinstance(doc, dict) or not isinstance(doc.get("messages"), list):
            raise Unknown("messages")
        out = _parts("/system", doc.get("system"))
        for i, m in enumerate(doc["messages"]):
            if not isinstance(m, dict):
                raise Unknown(f"/messages/{i}")
            out += _parts(f"/messages/{i}/content", m.get("content"))
            for k, call in enumerate(m.get("tool_calls") or ()):
                given = call["function"].get("arguments")
                out += [] if given is None else [_field(f"/messages/{i}/tool_calls/{k}", "rewrite", given)]
        if doc.get("metadata") is not None:
            out.append(_field("/metadata", "rewrite", doc["metadata"]))
        if doc.get("user") is not None:
            out.append(_field("/user", "judge", doc["user"]))
        for k, tool in enumerate(doc.get("tools") or ()):
            said = tool.get("description") or (tool.get("function") or {}).get("description")
            out += [_field(f"/tools/{k}/description", "judge", said)] if said else []
        return out
    except (ValueError, RecursionError, TypeError, AttributeError, KeyError):
        return [{"path": "", "mode": "invalid", "kind": None, "content": None}]


def _steps(path: str) -> list[str]:
    """The keys of a field's path; the arguments of a tool call lie in its function."""
    keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
    return [*keys, "function", "arguments"] if len(keys) == 4 and keys[2] == "tool_calls" else keys


def rewritten(body: str, changes: list[dict[str, str]]) -> str:
    """The body with the guarded fields (path, content) in their places, written anew.

    A field that was a text stays one: what was prose is unpacked, a container stays the
    text that the guard rebuilt.
    """
    doc = json.loads(body)
    for change in changes:
        *way, last = _steps(change["path"])
        node = doc
        for key in way:
            node = node[int(key)] if isinstance(node, list) else node[key]
        last = int(last) if isinstance(node, list) else last
        old, new = node[last], change["content"]
        node[last] = new if isinstance(old, str) and kind_of_text(old) != "text" else json.loads(new) if isinstance(old, (dict, list)) else json.loads(new)[0]
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def fields(df: DataFrame, key: str = "request_id", body: str = "body") -> DataFrame:
    """(key, path, mode, kind, content) of each request's texts; a request without any has one row of the mode ``none``."""
    return _fields(df, key, body).drop("__body")


def _fields(df: DataFrame, key: str, body: str) -> DataFrame:
    """As fields(), and the body beside the first field of each request."""

    @F.pandas_udf(_FIELD)
    def read(column: pd.Series) -> pd.Series:
        return pd.Series([read_fields(x) or [{"path": "", "mode": "none", "kind": None, "content": None}] for x in column], dtype=object)

    rows = df.select(key, F.col(body).alias("__body"), F.posexplode(read(body)).alias("n", "f"))
    return rows.select(key, "f.*", F.when(F.col("n") == 0, F.col("__body")).alias("__body"))


def guard_requests(df: DataFrame, key: str = "request_id", body: str = "body", **how: object) -> DataFrame:
    """(key, n_fields, n_rewritten, outcome, status, sent): a request passes if each field does, and the worst field decides.

    Every request has a row: one of no known shape is invalid.  ``sent`` is the body that may
    be sent on, byte for byte where nothing was rewritten, and null where nothing may pass.
    A request is known by its key; one group holds the fields of one request.
    """
    told = sanitize_records(_fields(df, key, body), **how)
    judged = (
        F.when(F.col("mode") == "invalid", "invalid").when(F.col("mode") == "none", "release").when(F.col("mode") == "refused", "blocked")
        .when(F.col("mode") == "judge", F.when(F.col("decision.verdict") == "BLOCK", "blocked").otherwise("release")).otherwise(outcome(F.col("decision.verdict"), F.col("released")))
    )
    worst = F.expr("array('release', 'approval_required', 'verification_failed', 'blocked', 'invalid')")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    changed = (F.col("mode") == "rewrite") & F.col("released") & (F.col("decision.verdict") == "SANITIZE")
    rows = told.withColumn("rank", F.array_position(worst, judged))
    out = rows.groupBy(key).agg(
        one(~F.col("mode").isin("none", "invalid")).alias("n_fields"), one(changed).alias("n_rewritten"), F.max("rank").alias("rank"), F.max("__body").alias("__body"),
        F.collect_list(F.when(changed, F.struct("path", F.col("sanitized").alias("content")))).alias("changes"),
    )
    named = F.element_at(worst, F.col("rank").cast("int"))

    @F.pandas_udf("string")
    def written(bodies: pd.Series, changes: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else rewritten(b, list(c)) if len(c) else b for b, c in zip(bodies, changes, strict=True)], dtype=object)

    sent = F.when(named == "release", F.when(F.size("changes") == 0, F.col("__body")).otherwise(written(F.when(named == "release", F.col("__body")), "changes")))
    return out.select(key, "n_fields", "n_rewritten", named.alias("outcome"), status_code(named).alias("status"), sent.alias("sent"))


# The paths that are served, the largest body, and the errors of what is not looked at.
ROUTES = ("/v1/chat/completions", "/v1/messages")
LARGEST_BODY = 10 * 1024 * 1024


def transport_status(method: Column, path: Column, length: Column, body: Column, largest: int = LARGEST_BODY) -> Column:
    """The status of a request that is refused before it is read: 404 unknown path, 411 no length, 413 too large, 400 a length that is none or not the body's; null where the guard decides."""
    served = (F.upper(method) == "POST") & F.regexp_extract(path, r"^[^?#]*", 0).isin(*ROUTES)
    number = F.trim(length).try_cast("long")
    return (
        F.when(~F.coalesce(served, F.lit(False)), 404).when(length.isNull(), 411).when(number.isNull() | (number < 0), 400).when(number > largest, 413)
        .when(F.coalesce(F.octet_length(body), F.lit(0)) != number, 400)
    )


def answer_status(sent: Column, upstream: Column) -> Column:
    """The status that a caller gets for what was sent on: the upstream's own, or 502 where none came back."""
    return F.when(sent.isNotNull(), F.coalesce(upstream, F.lit(502)))


def gateway(df: DataFrame, key: str = "request_id", method: str = "method", path: str = "path", length: str = "length", body: str = "body", **how: object) -> DataFrame:
    """(key, outcome, status, sent, error) of HTTP requests: what is refused by its transport is never read, the rest is guarded.

    ``error`` is a JSON body with a type and no value of the request, null where something is sent on.
    """
    rows = df.select(key, F.col(body).alias("body"), transport_status(F.col(method), F.col(path), F.col(length), F.col(body)).alias("early"))
    told = guard_requests(rows.withColumn("body", F.when(F.col("early").isNull(), F.col("body")).otherwise('{"messages":[]}')), key, "body", **how)
    out = told.join(rows.select(key, "early"), key)
    status = F.coalesce("early", "status")
    result = F.when(F.col("early").isNotNull(), "invalid").otherwise(F.col("outcome"))
    kinds = {404: "not_found", 411: "length_required", 413: "request_too_large", 400: "invalid_request_error", 422: "privacy_guard_verification_failed"}
    kind = F.when((status == 403) & (result == "approval_required"), "privacy_guard_ask").when(status == 403, "privacy_guard_block")
    for code, name in kinds.items():
        kind = kind.when(status == code, name)
    error = F.when(kind.isNotNull(), F.to_json(F.struct(F.struct(kind.alias("type")).alias("error"))))
    return out.select(key, result.alias("outcome"), status.alias("status"), F.when(F.col("early").isNull(), F.col("sent")).alias("sent"), error.alias("error"))
