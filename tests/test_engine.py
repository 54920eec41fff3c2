"""The guard and its parts: spans against Python's re, goldens, and measurements."""

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from hushframe.functions.hashes import hmac_sha256
from hushframe.functions.spans import spans, strip_invisible
from hushframe.operators import audit, dataset
from hushframe.operators.detect import DETECTORS, detect, numeral_table, parse_date
from hushframe.operators.report import render
from hushframe.plans.guard import sanitize
from hushframe.plans.policy import PROFILES, Profile, from_mapping
from hushframe.sources.structured import Refused, csv_table, fhir_names, fhir_resources, json_leaves, rebuilt


def found(spark, text, *names):
    row = spark.createDataFrame([(text,)], "t string").select(detect(F.col("t"), names or None).alias("f")).first()
    return [(f["type"], f["start"], f["end"], f["value"]) for f in row["f"]]


@pytest.mark.parametrize("text", ["", "no digits", "12 and 345", "😀12😀3", "x1", "１２ 3"])
def test_spans_are_code_points(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), "", r"\d+").alias("s")).first()
    assert [(s["start"], s["value"]) for s in row["s"]] == [(m.start(), m[0]) for m in re.finditer(r"\d+", text)]


def test_golden_note(spark):
    text = "患者张三，男，45岁，手机13800138000，于2023年5月6日就诊于北京协和医院，邮箱 a.b@example.com。"
    rows = spark.createDataFrame([(1, text), (2, "hello"), (3, None), (4, "a\x01b")], "id int, text string")
    told = {r["id"]: r for r in sanitize(rows).collect()}
    assert told[1]["sanitized"] == "患者[PERSON_NAME_001]，男，40-49岁，手机[REDACTED]，于2023年5月就诊于[INSTITUTION_GENERALIZED]，邮箱 [REDACTED]。"
    assert told[1]["released"] and told[1]["verification"]["passed"]
    assert told[2]["decision"]["verdict"] == "ALLOW" and told[2]["sanitized"] == "hello"
    assert told[3]["decision"]["verdict"] == told[4]["decision"]["verdict"] == "BLOCK" and told[3]["sanitized"] is None
    assert sanitize(rows).where("released").count() == 2


def test_non_detections(spark):
    assert found(spark, "日期2023-02-30，编号138001380001，纳入60岁，转至上级医院，心内科说明，5床位") == []


def test_dates_and_numerals(spark):
    values = ["2024/02/29", "2023-02-30", "3/4/2021", "二〇二四年二月二十九日", "２０２３．１．２"]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v string").select(parse_date(F.col("v"))).collect()]
    assert got == ["2024-02-29", "None", "2021-03-04", "2024-02-29", "2023-01-02"]
    assert numeral_table()["二十三"] == 23 and numeral_table()["十"] == 10 and len(DETECTORS) == 26


def test_strip_invisible(spark):
    assert spark.createDataFrame([("a​b‮c\U000e0041",)], "t string").select(strip_invisible(F.col("t"))).first()[0] == "abc"


def test_profiles_are_checked():
    good = PROFILES["external-ai-strict"]
    with pytest.raises(ValueError):
        Profile("x", good.identifiers, good.medical, {}, good.purpose_risk, good.hard)
    with pytest.raises(ValueError):
        Profile("x", {"PHONE": ("REMOVE", True)}, good.medical, good.recipient_risk, good.purpose_risk, good.hard)
    with pytest.raises(ValueError):
        from_mapping({"profile": "x", "surprise": 1})


def test_structured():
    doc = json.loads('{"name": "张三", "n": [1.50, true, null, 1e3], "a/b": {"~k": "v"}}')
    assert [(x["path"], x["text"], x["read_only"]) for x in json_leaves(doc)] == [("/name", "张三", False), ("/n/0", "1.5", True), ("/n/3", "1000.0", True), ("/a~1b/~0k", "v", False)]
    assert json.loads(rebuilt("json", json.dumps(doc), ["X", "1.5", "1000.0", "w"])) == {"name": "X", "n": [1.5, True, None, 1000.0], "a/b": {"~k": "w"}}
    assert csv_table("姓名,x\n张三,1\n")[0] == ["姓名", "x"] and csv_table("1,2\n")[0] is None
    with pytest.raises(Refused):
        csv_table(" \n")
    patient = {"resourceType": "Patient", "name": [{"family": "张", "given": ["伟"]}], "contained": [{"resourceType": "Provenance"}]}
    assert [t for t, _ in fhir_resources(patient)] == ["Patient", "Provenance"]
    assert fhir_names(patient) == {"/name/0/family": "张伟", "/name/0/given/0": "张伟"}


def test_hmac(spark):
    for key in (b"k", b"long" * 30):
        assert spark.range(1).select(hmac_sha256(F.lit("é"), key)).first()[0] == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest()


def test_risk_of_no_rows(spark):
    row = dataset.risk(spark.createDataFrame([], "a string"), ["a"]).first()
    assert row["row_count"] == 0 and row["singleton_fraction"] == 0.0


def test_report_is_escaped():
    page = render("<t>", [("a", "<b>", 3), ("a", "c", 1)])
    assert "<b>" not in page and "&lt;b&gt;" in page and "width:33%" in page


def test_audit_text(spark):
    row = {"event_id": 'e"1', "timestamp": "t", "decision": "ALLOW", "reason_codes": ["A", "é"], "entity_counts": {"B": 2, "A": 1}, "risk_level": "LOW", "risk_score": 5, "recipient_class": "LOCAL", "purpose": "RESEARCH", "policy_profile": "p", "policy_version": "p/1", "transformations": [], "verification": "PASS", "prev_hash": "", "dictionary_loaded": False, "dictionary_entries": 0, "grant_id": "", "grant_issuer": ""}
    schema = ", ".join(x for x in audit.EVENT.split(", ") if not x.startswith("event_hash"))
    names = [x.split(" ")[0] for x in schema.split(", ")]
    log = spark.createDataFrame([tuple(row[n] for n in names)], schema)
    assert log.select(audit.canonical_event()).first()[0] == json.dumps(row, ensure_ascii=False, sort_keys=True)


def test_stream_of_requests(spark, tmp_path):
    from hushframe.streaming.requests import guard_lines, read_lines

    (tmp_path / "in").mkdir()
    lines = ['{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"arguments":{"q":"a@b.example.com"}}}', '{"method":"x"}', '[{"method":"tools/call"}]']
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    run = guard_lines(read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("guarded").trigger(availableNow=True).start()
    run.awaitTermination()
    told = {r["line"]: (r["action"], r["out"]) for r in spark.table("guarded").collect()}
    assert told[lines[0]] == ("rewrite", lines[0].replace("a@b.example.com", "[REDACTED]")) and told[lines[1]] == ("pass", lines[1]) and told[lines[2]][0] == "refuse"


def test_no_planted_value_leaves_a_call(spark):
    from hushframe.streaming.requests import guard_lines

    mail = "a@b.example.com"
    lines = [
        '{"method": "tools/call", "id": 1, "params": {"arguments": {"q": "mail ' + mail + '"}}}',
        '{"method":"tools/call","id":1,"params":{"arguments":{"q":"caf\\u00e9 ' + mail + '"}}}',
        '{"method":"tools/call","id":1,"params":{"arguments":{"q":"x"},"inputResponses":["' + mail + '"]}}',
        '[{"method" : "tools\\/call", "params":{"arguments":"' + mail + '"}}]',
        '{"method":"tools/call","id":"s","params":{"arguments":"{\\"q\\": \\"' + mail + '\\"}"}}',
        '{"method":"tools/call","params":{"arguments":"{} {' + mail + '}"}}',
        '{"method":"tools/call","id":2,"params":{"arguments":{"q":"\\ud800 ' + mail + '"}}}',
        "not a message", "", '{"method":"tools/call","id":3}',
    ]
    told = {r["line"]: (r["action"], r["out"]) for r in guard_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert [told[x][0] for x in lines] == ["rewrite", "rewrite", "rewrite", "refuse", "rewrite", "refuse", "refuse", "pass", "pass", "pass"]
    assert all(mail not in (told[x][1] or "") for x in lines[:7])
    assert json.loads(told[lines[0]][1])["params"]["arguments"]["q"].startswith("mail [") and told[lines[5]][1] is None


def test_every_request_has_a_row(spark):
    from hushframe.operators.chat import guard_requests

    mail = "a@b.example.com"
    bodies = [
        "not json", '{"model": "m"}', '{"messages": [7]}', None, '{"messages": []}', '{"messages": [{"content": "hello"}]}',
        '{"messages": [{"content": "x"}], "metadata": {"who": "' + mail + '"}}',
        '{"messages": [{"content": null, "tool_calls": [{"function": {"arguments": "{\\"to\\": \\"' + mail + '\\"}"}}]}]}',
        '{"messages": [{"content": [{"type": "tool_result", "content": [{"type": "text", "text": "' + mail + '"}]}]}], "system": [{"type": "text", "text": "be brief"}]}',
        '{"messages": [{"content": [{"type": "image_url"}]}]}',
    ]
    out = {r["request_id"]: r for r in guard_requests(spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")).collect()}
    assert [out[i]["status"] for i in range(len(bodies))] == [400, 400, 400, 400, 200, 200, 200, 200, 200, 403]
    assert [out[i]["n_rewritten"] for i in (5, 6, 7, 8)] == [0, 1, 1, 1]


def test_one_bad_payload_closes_itself(spark):
    from hushframe.plans.records import sanitize_records

    rows = [("json", '{"a":"\\ud800"}'), ("json", '{"\\ud800":"x"}'), ("json", "[" * 5000), ("json", '{"a":"x"}'), (None, "x"), ("csv", None)]
    told = [(r["decision"]["verdict"], r["released"]) for r in sanitize_records(spark.createDataFrame(rows, "kind string, content string")).collect()]
    assert told == [("BLOCK", False)] * 3 + [("ALLOW", True)] + [("BLOCK", False)] * 2


def test_detection_is_planned_once_and_filters_reach_the_scan(spark, tmp_path):
    from hushframe.operators.detect import with_facts

    spark.createDataFrame([(1, "a@b.example.com", "x")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once = plan(with_facts(rows)).count("regexp_replace")
    assert plan(with_facts(rows).select("doc_id", F.explode("facts").alias("f")).where("f.type = 'EMAIL'")).count("regexp_replace") == once
    filtered = plan(sanitize(rows).where("doc_id = 5 and lang = 'x' and released"))
    assert "EqualTo(doc_id,5)" in filtered and "EqualTo(lang,x)" in filtered
    assert filtered.count("regexp_replace") <= plan(sanitize(rows)).count("regexp_replace") + 4


def test_custom_detectors_look_again(spark):
    from hushframe.operators.dictionary import dictionary_facts

    terms = [("Northfield", "institution")]
    rows = spark.createDataFrame([(1, "seen at Northfield today")], "id int, text string")
    out = sanitize(rows, extra=[lambda text: dictionary_facts(text, terms)]).first()
    assert out["released"] and "Northfield" not in out["sanitized"]


def test_marks_in_a_text_do_no_harm(spark):
    assert found(spark, "x\x01\x02\x03 a@b.example.com", "email") == [("EMAIL", 5, 20, "a@b.example.com")]


def test_labelled_corpus(spark, tmp_path):
    from hushframe.sources.corpus import labelled_corpus

    good = {"doc_id": "a", "document_type": "lab", "expected_verdict": "SANITIZE", "spans": [{"type": "PHONE", "start": 0, "end": 2}]}
    cases = {
        "a": (good, "xy"), "b": ({**good, "doc_id": "b", "spans": [{"type": "PHONE", "start": 0, "end": 3}]}, "xy"), "c": ({**good, "doc_id": "c", "expected_verdict": "MAYBE"}, "xy"),
        "d": ({**good, "doc_id": "d"}, None), "e": ({**good, "doc_id": "e", "spans": good["spans"] * 2}, "xy"), "f": ({"doc_id": "f", "expected_verdict": "ALLOW"}, "xy"), "g": ({**good, "doc_id": "../g"}, "xy"),
    }
    for stem, (side, text) in cases.items():
        (tmp_path / f"{stem}.spans.json").write_text(json.dumps(side))
        if text is not None:
            (tmp_path / f"{stem}.txt").write_text(text)
    told = {r["doc_id"]: r["problem"] for r in labelled_corpus(spark, str(tmp_path)).collect()}
    assert told == {"a": None, "b": "bad span", "c": "unknown verdict", "d": "no text", "e": "repeated span", "f": "unreadable sidecar", "../g": "bad or repeated id"}


def test_audit_log_round_trip_and_chain(spark, tmp_path):
    from hushframe.sources.corpus import duplicate_events, read_events, write_events

    base = {"timestamp": "t", "decision": "ALLOW", "reason_codes": ["A"], "entity_counts": {"B": 2}, "risk_level": "LOW", "risk_score": 5, "recipient_class": "LOCAL", "purpose": "RESEARCH", "policy_profile": "p", "policy_version": "p/1", "transformations": [], "verification": "PASS"}
    lines, last = [], ""
    for i in range(30):
        event = {"event_id": f"e{i}", **base, "prev_hash": last}
        last = hashlib.sha256(json.dumps(event, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
        lines.append(json.dumps({**event, "event_hash": last}))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join([*lines, "", "no event", lines[3]]))
    log = read_events(spark, str(tmp_path / "log"))
    assert [r["seq"] for r in log.where("broken").collect()] == [31]
    assert {r["event_id"]: r["n"] for r in duplicate_events(log.where("not broken")).collect()} == {"e3": 2}
    sound = log.where("not broken and seq < 30")
    assert audit.chain_report(sound).first().asDict() == {"total": 30, "chained": 30, "unchained": 0, "failures": 0}
    changed = sound.withColumn("risk_score", F.when(F.col("seq") == 7, 6).otherwise(F.col("risk_score"))).where("seq <> 20")
    assert {r["seq"]: r["problem"] for r in audit.verify_chain(changed).where("problem is not null").collect()} == {7: "hash", 21: "link"}
    write_events(sound.drop("file", "seq", "broken"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_events(sound, str(tmp_path / "out"))


def test_tokens_are_numbered_across_ranges(spark):
    rows = [(f, o, 0, "PHONE", f"v{(f * 7 + o) % 40}") for f in range(10) for o in range(20)]
    out = {r["value"]: r["number"] for r in dataset.batch_tokens(spark.createDataFrame(rows, "file_no int, op_no int, start int, type string, value string")).collect()}
    first = list(dict.fromkeys(v for *_, v in sorted(rows)))
    assert out == {v: i for i, v in enumerate(first, 1)}


def test_checks_of_a_release_can_fail(spark):
    from hushframe.operators.transform import EVIDENCE
    from hushframe.operators.verify import verify

    rows = sanitize(spark.createDataFrame([(1, "mail a@b.example.com now")], "id int, text string")).select("id", "text", "facts")
    checked = lambda out: rows.select(verify(F.col("text"), F.col("facts"), F.array().cast(EVIDENCE), F.lit(out), F.col("facts"), F.lit("EXTERNAL_APPROVED"), F.lit("RESEARCH"), PROFILES["external-ai-strict"])["passed"]).first()[0]
    assert not checked("mail a@b.example.com now") and not checked("mail [REDACTED] later")


def test_payloads_by_kind(spark, tmp_path):
    from hushframe.plans.payloads import exit_code, guard_payloads, released_or_fail, union_of, with_payload

    rows = [(1, '{"name": "张三"}', None), (2, "姓名\n张三\n", "CSV"), (3, "姓名\n张三\n", None), (4, "x", "pdf"), (5, None, None), (6, "a\x02", "text"), (7, "", None), (8, "he\u200bllo", "text")]
    df = spark.createDataFrame(rows, "id int, content string, declared string")
    assert {r["id"]: r["kind"] for r in with_payload(df, declared="declared").collect()} == {1: "json", 2: "csv", 3: "text", 4: "unsupported", 5: "unsupported", 6: "unsupported", 7: "text", 8: "text"}
    told = guard_payloads(df, declared="declared").select("id", "decision", "sanitized", "released", "verification").cache()
    got = {r["id"]: (r["decision"]["verdict"], r["sanitized"]) for r in told.collect()}
    assert got[1] == ("SANITIZE", '{\n  "name": "[PERSON_NAME_001]"\n}') and got[2] == ("SANITIZE", "姓名\n[PERSON_NAME_001]\n")
    assert got[4] == got[5] == got[6] == ("BLOCK", None) and got[7] == ("ALLOW", "") and got[8] == ("ALLOW", "hello")
    assert exit_code(told).first()[0] == 4 and exit_code(told.where("released")).first()[0] == 0
    assert told.where("released").select(released_or_fail()).count() > 0
    with pytest.raises(Exception, match="blocked"):
        told.select(released_or_fail()).collect()
    with pytest.raises(Exception, match="(?i)column"):
        union_of([told.select("id"), told.select("released")]).collect()


def test_read_only_values_move_with_the_text(spark):
    from hushframe.functions.spans import FACTS
    from hushframe.operators.transform import EVIDENCE
    from hushframe.operators.verify import with_read_only

    fact = lambda a, b, ro: ("PHONE", a, b, 1.0, "s", "v", ro, 0)
    done = [("AGE", "REMOVE", 0, 2, 0, 10, "xx", "[REDACTED]")]
    row = [([fact(13, 15, False), fact(20, 22, False)], [fact(5, 7, True)], done, ["PHONE"]), ([fact(13, 15, False)], [fact(5, 7, True)], done, ["AGE"]), ([fact(13, 15, False)], [fact(5, 7, True)], done, None)]
    df = spark.createDataFrame(row, f"r {FACTS}, f {FACTS}, d {EVIDENCE}, a array<string>")
    marks = [[x["read_only"] for x in r[0]] for r in df.select(with_read_only(F.col("r"), F.col("f"), F.col("d"), F.col("a"))).collect()]
    assert marks == [[True, False], [False], [False]]


def test_an_approval_is_no_licence_to_leave_what_can_be_rewritten(spark):
    rows = spark.createDataFrame([(1, "患者：张三，本县唯一，电话 13800138000。")], "id int, text string")
    got = sanitize(rows, accepted=F.array(F.lit("PHONE"), F.lit("PERSON_NAME"))).first()
    assert got["released"] and got["sanitized"] == "患者：[PERSON_NAME_001]，本县唯一，电话 [REDACTED]。"
    closed = spark.createDataFrame([(1, None)], "id int, text string")
    assert not sanitize(closed, accepted=F.array(F.lit("PHONE"))).first()["released"]


def test_batch_is_written_once(spark, tmp_path):
    from hushframe.plans.batch import sanitize_batch, write_batch

    files = spark.createDataFrame([(1, "csv", "姓名\n张三\n"), (2, "csv", " "), (3, "csv", "姓名\n李四\n张三\n")], "file_no int, kind string, content string")
    told = sanitize_batch(files)
    write_batch(told, str(tmp_path / "out"))
    texts = {r["file"]: r["value"] for r in spark.read.option("lineSep", "\x00").text(str(tmp_path / "out" / "files")).selectExpr("cast(file as int) AS file", "value").collect()}
    assert texts == {1: "姓名\n[PERSON_NAME_001]\n\n", 3: "姓名\n[PERSON_NAME_002]\n[PERSON_NAME_001]\n\n"}
    assert {(r["file_no"], r["decision"], r["released"]) for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()} == {(1, "SANITIZE", True), (2, "BLOCK", False), (3, "SANITIZE", True)}
    with pytest.raises(Exception, match="(?i)exists"):
        write_batch(told, str(tmp_path / "out"))


def test_table_files():
    from hushframe.sources.structured import table_of

    assert table_of("csv", "a,b\n1,\n\n2,x\n") == [{"a": "1", "b": ""}, {"a": "2", "b": "x"}]
    assert table_of("json", '[{"a": 1.50, "b": null}]') == [{"a": "1.5", "b": None}] and table_of("json", "[]") == []
    for kind, text in (("csv", ""), ("csv", "a,\n1,2"), ("csv", "a,a\n"), ("csv", "a\n1,2"), ("json", "1"), ("json", "[1]"), ("json", '{"a": NaN}'), ("json", '{"a": 1, "a": 1}'), ("json", "{"), ("text", "a")):
        with pytest.raises(Refused):
            table_of(kind, text)


def test_survival_of_odd_values(spark):
    from hushframe.operators.scoring import in_order, still_present, survives

    rows = spark.createDataFrame([("a\\Eb", "x a\\Eb"), (".*", "abc"), ("29岁", "20-29岁"), ("29岁", "29岁"), ("90岁", "90岁及以上")], "v string, t string")
    assert [tuple(r) for r in rows.select(survives(F.col("v"), F.col("t")), still_present(F.col("v"), F.col("t"))).collect()] == [(True, True), (False, False), (False, False), (True, True), (False, True)]
    names = spark.createDataFrame([("z",), ("b",), ("a",), ("c",)], "name string")
    assert [r[0] for r in in_order(names, ["c", "a"]).collect()] == ["c", "a", "b", "z"]
