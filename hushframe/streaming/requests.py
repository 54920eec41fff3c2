"""Request streams under the guard, and audit counts over time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.plans.records import sanitize_records
from hushframe.sources.structured import kind_of_text

#: JSON-RPC error code of a refused call.
REFUSED_CODE = 4001
#: Fields of a call's parameters that are looked at; fixed values of the protocol.
INSPECTED = ("arguments", "inputResponses")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of files that arrive in a folder."""
    return spark.readStream.format("text").load(path).withColumnRenamed("value", "line")


def _parsed(line: str | None) -> object:
    try:
        return json.loads(line or "")
    except (ValueError, RecursionError):
        return None


def _is_call(message: object) -> bool:
    return isinstance(message, dict) and message.get("method") == "tools/call"


def _told(line: str | None) -> tuple[str, str | None, str | None]:
    """(pass, refuse or call, the request's id as JSON, the inspected fields as one JSON object)."""
    message = _parsed(line)
    if isinstance(message, list):
        return ("refuse" if any(map(_is_call, message)) else "pass"), None, None
    if not _is_call(message) or not isinstance(message.get("params"), dict):
        return "pass", None, None
    held = {}
    for name in INSPECTED:
        if name in message["params"]:
            value = message["params"][name]
            if isinstance(value, str):
                kind = kind_of_text(value)
                if kind == "unsupported":
                    return "refuse", json.dumps(message["id"]) if "id" in message else None, None
                # a container in a text is judged by its own keys
                value = json.loads(value) if kind != "text" else value
            held[name] = value
    return "call", json.dumps(message["id"]) if "id" in message else None, json.dumps(held)


def _with(line: str, fields: str) -> str | None:
    """The message with the fields in place, or null where they cannot be put there."""
    message, new = _parsed(line), _parsed(fields)
    if not _is_call(message) or not isinstance(new, dict):
        return None
    for name, value in new.items():
        old = message["params"].get(name)
        message["params"][name] = json.dumps(value) if isinstance(old, str) and not isinstance(value, str) else value
    return json.dumps(message, separators=(",", ":"))


def guard_lines(lines: DataFrame, **how: object) -> DataFrame:
    """``lines`` with action and out: JSON-RPC lines (column line) after the guard; works on streams and tables alike.

    Other columns pass, so that a row is known by its own key and not by its text.

    Only ``tools/call`` is looked at, by the parsed message: its arguments and its
    input responses are judged together as one structured payload and the message
    is written anew.  Lines that are no message and other messages pass byte for
    byte.  An array that holds a call is refused whole.  A refused request is
    answered with an error, a refused notification with nothing.
    """
    @F.pandas_udf("step string, id string, content string")
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_told(x) for x in column], columns=["step", "id", "content"])

    @F.pandas_udf("string")
    def written(column: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else _with(x, f) for x, f in zip(column, fields, strict=True)], dtype=object)

    # their own columns go through the work as one, so that no name of theirs meets one of its
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(lines.columns)))
    rows = lines.select("line", own.alias("__own"), read("line").alias("__m")).select("line", "__own", "__m.*").withColumn("kind", F.when(F.col("step") == "call", "json"))
    told = sanitize_records(rows, **how)
    told = told.withColumn("__out", written("line", F.when((F.col("step") == "call") & F.col("released"), F.col("sanitized"))))
    error = F.when(F.col("id").isNotNull(), F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.col("id"), F.lit(f',"error":{{"code":{REFUSED_CODE},"message":"refused"}}}}')))
    done = F.when(F.col("step") != "call", F.col("step")).when(F.col("__out").isNull(), "refuse").when(F.col("decision.verdict") == "ALLOW", "forward").otherwise("rewrite")
    told = told.withColumn("action", done)
    out = F.when(F.col("action") == "pass", F.col("line")).when(F.col("action") == "refuse", error).otherwise(F.col("__out"))
    return told.select(*(F.col(f"__own.c{i}").alias(c) for i, c in enumerate(lines.columns)), "action", out.alias("out"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, decision, n) of an event stream (ts, decision) by tumbling windows; later events than ``late`` are left out."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "decision").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "decision", "n")
