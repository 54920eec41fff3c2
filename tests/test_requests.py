"""Requests that can be sent on: rebuilt bodies of both shapes, and what is refused before it is read."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators.chat import answer_status, gateway, guard_requests

MAIL = "a@b.example.com"
BODIES = {
    "openai": {"model": "m", "messages": [{"role": "user", "content": f"mail {MAIL}"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": json.dumps({"q": MAIL, "n": 3})}}]}], "metadata": {"k": MAIL}, "user": "u1"},
    "anthropic": {"system": [{"type": "text", "text": f"to {MAIL}"}], "messages": [{"role": "user", "content": [{"type": "tool_use", "input": {"q": MAIL}}, {"type": "tool_result", "content": f"got {MAIL}"}, {"type": "text", "text": "fine", "odd/key~": MAIL}]}], "tools": [{"description": "looks up"}]},
    "plain": {"messages": [{"role": "user", "content": "hello"}], "temperature": 0.5},
    "image": {"messages": [{"role": "user", "content": [{"type": "image", "source": {}}, {"type": "text", "text": MAIL}]}]},
    "shapeless": {"messages": 3},
}


@pytest.fixture(scope="module")
def sent(spark):
    rows = [(k, json.dumps(v)) for k, v in BODIES.items()]
    return {r["request_id"]: r for r in guard_requests(spark.createDataFrame(rows, "request_id string, body string")).collect()}


def test_bodies_are_rebuilt(sent):
    told = json.loads(sent["openai"]["sent"])
    assert told["messages"][0]["content"] == "mail [REDACTED]" and told["metadata"] == {"k": "[REDACTED]"} and told["user"] == "u1" and told["model"] == "m"
    call = told["messages"][1]["tool_calls"][0]
    assert call["id"] == "c" and json.loads(call["function"]["arguments"]) == {"q": "[REDACTED]", "n": 3} and told["messages"][1]["content"] is None
    told = json.loads(sent["anthropic"]["sent"])
    parts = told["messages"][0]["content"]
    assert told["system"][0] == {"type": "text", "text": "to [REDACTED]"} and parts[0]["input"] == {"q": "[REDACTED]"}
    assert parts[1]["content"] == "got [REDACTED]" and parts[2] == {"type": "text", "text": "fine", "odd/key~": "[REDACTED]"}
    assert all(MAIL not in (r["sent"] or "") for r in sent.values())


def test_nothing_to_rewrite_is_sent_byte_for_byte_and_what_is_refused_not_at_all(sent):
    assert sent["plain"]["sent"] == json.dumps(BODIES["plain"]) and sent["plain"]["n_rewritten"] == 0
    assert (sent["image"]["status"], sent["image"]["sent"]) == (403, None)
    assert (sent["shapeless"]["status"], sent["shapeless"]["sent"]) == (400, None)


def test_gateway(spark):
    body = json.dumps(BODIES["openai"])
    rows = [
        (1, "POST", "/v1/messages?x=1", str(len(body)), body), (2, "POST", "/v1/other", "5", "hello"), (3, "POST", "/v1/messages", None, body), (4, "POST", "/v1/messages", "99999999", body),
        (5, "POST", "/v1/messages", "abc", body), (6, "POST", "/v1/messages", "7", body), (7, "GET", "/v1/messages", "0", ""), (8, "POST", "/v1/chat/completions", "4", "[1] "), (9, "POST", None, None, None),
    ]
    told = gateway(spark.createDataFrame(rows, "request_id int, method string, path string, length string, body string")).withColumn("answer", answer_status(F.col("sent"), F.lit(None).cast("int")))
    found = {r["request_id"]: (r["status"], (json.loads(r["error"])["error"]["type"] if r["error"] else None), r["sent"] is not None, r["answer"]) for r in told.collect()}
    assert found == {
        1: (200, None, True, 502), 2: (404, "not_found", False, None), 3: (411, "length_required", False, None), 4: (413, "request_too_large", False, None), 5: (400, "invalid_request_error", False, None),
        6: (400, "invalid_request_error", False, None), 7: (404, "not_found", False, None), 8: (400, "invalid_request_error", False, None), 9: (404, "not_found", False, None),
    }
