"""Streams with state: use budgets over restarts, and the audit log as a chain of batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit, grants
from hushframe.streaming.audit_log import ChainedLog, write_audit
from hushframe.streaming.budgets import ROCKSDB, consume_stream

ATTEMPT = "grant_key string, seq long, at timestamp, uses_allowed long, expires_at timestamp"
REVOCATION = "grant_key string, at timestamp"
T0 = dt.datetime(2026, 1, 1, 12)


def minute(n):
    return (T0 + dt.timedelta(minutes=n)).isoformat()


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.unset(name)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def use(key, seq, at, allowed=2, ends=60):
    return {"grant_key": key, "seq": seq, "at": minute(at), "uses_allowed": allowed, "expires_at": minute(ends)}


def run(spark, tmp_path):
    """All that has arrived, from the checkpoint of the runs before."""
    for name in ("uses", "gone"):
        (tmp_path / name).mkdir(exist_ok=True)
    attempts = spark.readStream.schema(ATTEMPT).json(str(tmp_path / "uses"))
    gone = spark.readStream.schema(REVOCATION).json(str(tmp_path / "gone"))
    told = consume_stream(attempts, gone)
    query = told.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive
    out = spark.read.schema("grant_key string, seq long, outcome string, consumed boolean").json(str(tmp_path / "out"))
    return {(r["grant_key"], r["seq"]): r["outcome"] for r in out.collect()}


def test_budgets_over_restarts(spark, tmp_path, rocks):
    put(tmp_path / "gone", "a.json", [{"grant_key": "early", "at": minute(0)}])
    first = [use("a", 1, 1), use("a", 2, 2, allowed=2), use("b", 3, 3), use("early", 4, 1), use("c", 5, 61), use("d", 6, 1), use("d", 7, 2, allowed=3), {"grant_key": None, "seq": 1, "at": minute(1)}]
    put(tmp_path / "uses", "a.json", first)
    told = run(spark, tmp_path)
    assert told == {("a", 1): "consumed", ("a", 2): "consumed", ("b", 3): "consumed", ("early", 4): "revoked", ("c", 5): "expired", ("d", 6): "consumed", ("d", 7): "conflict"}
    # a new run knows what was used; a revocation holds for what comes with and behind it
    put(tmp_path / "gone", "b.json", [{"grant_key": "b", "at": minute(55)}])
    put(tmp_path / "uses", "b.json", [use("a", 8, 55), use("b", 9, 55), use("d", 10, 56)])
    told = run(spark, tmp_path)
    assert {k: told[k] for k in (("a", 8), ("b", 9), ("d", 10))} == {("a", 8): "exhausted", ("b", 9): "revoked", ("d", 10): "consumed"}
    # the watermark passes the expiry of all grants; then late attempts meet no state and are left out
    put(tmp_path / "uses", "c.json", [use("z", 11, 200, ends=300)])
    run(spark, tmp_path)
    put(tmp_path / "uses", "d.json", [use("a", 12, 50), use("z", 13, 201, ends=300)])
    told = run(spark, tmp_path)
    assert ("a", 12) not in told and told["z", 13] == "consumed"


def test_stream_and_table_take_the_same_uses(spark, tmp_path, rocks):
    attempts = [use(f"g{i % 5}", i, i % 50, allowed=1 + i % 5, ends=30 + 5 * (i % 5)) for i in range(60)]
    put(tmp_path / "uses", "a.json", attempts)
    put(tmp_path / "gone", "a.json", [{"grant_key": "g3", "at": minute(0)}])
    told = run(spark, tmp_path)
    rows = spark.read.schema(ATTEMPT).json(str(tmp_path / "uses"))
    held = rows.select("grant_key", "uses_allowed", "expires_at").distinct().withColumn("uses_consumed", F.lit(0))
    want = grants.consume(rows.select("grant_key", "seq", "at"), held, spark.read.schema(REVOCATION).json(str(tmp_path / "gone")))
    assert {k: v == "consumed" for k, v in told.items()} == {(r["grant_key"], r["seq"]): r["consumed"] for r in want.collect()}


# -- audit log -----------------------------------------------------------------------

EVENT = {"decision": "ALLOW", "reason_codes": ["A", 'quo"te'], "entity_counts": {"B": 2, "A": 1}, "risk_level": "LOW", "risk_score": 5, "recipient_class": "LOCAL", "purpose": "RESEARCH", "policy_profile": "p", "policy_version": "p/1", "transformations": [], "verification": "PASS"}


def events(spark, ids):
    rows = [json.dumps({**EVENT, "event_id": f"e{i:03d}", "timestamp": minute(i)}) for i in ids]
    return spark.createDataFrame([(r,) for r in rows], "line string").select(F.from_json("line", audit.EVENT).alias("e")).select("e.*").drop("prev_hash", "event_hash")


@pytest.mark.parametrize("key", [None, b"secret"])
def test_batches_make_one_chain(spark, tmp_path, key):
    log = ChainedLog(str(tmp_path / "log"), key)
    log(events(spark, range(20)), 0)
    log(events(spark, range(20, 25)), 1)
    log(events(spark, range(20, 25)), 1)  # replayed
    log(events(spark, []), 2)
    log(events(spark, range(30, 40)), 3)
    read = log.events(spark)
    assert [r["event_id"] for r in read.orderBy("seq").collect()] == [f"e{i:03d}" for i in (*range(25), *range(30, 40))]
    assert audit.chain_report(read, key=key).first().asDict() == {"total": 35, "chained": 35, "unchained": 0, "failures": 0}
    last = log.heads(spark).orderBy(F.desc("batch")).first()
    assert (last["batch"], last["seq"], last["event_hash"]) == (3, 35, audit.chain_head(read).first()["event_hash"])
    assert audit.verify_chain(read.where("event_id <> 'e007'"), key=key).where("problem is not null").count() == 1


def test_a_batch_that_was_not_committed_is_written_again(spark, tmp_path):
    log = ChainedLog(str(tmp_path / "log"))
    log(events(spark, range(3)), 0)
    # what an attempt that ended before its head left
    log._chained(events(spark, [99]), 3, "x").write.text(f"{log.path}/events/batch={1:012d}")
    assert log.events(spark).count() == 3
    log(events(spark, range(3, 6)), 1)
    assert audit.chain_report(log.events(spark)).first().asDict() == {"total": 6, "chained": 6, "unchained": 0, "failures": 0}


def test_a_stream_of_events_is_appended_once(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{**EVENT, "event_id": f"e{i}", "timestamp": minute(i)} for i in range(5)])

    def go():
        stream = spark.readStream.schema(audit.EVENT).json(str(tmp_path / "in")).drop("prev_hash", "event_hash")
        write_audit(stream, str(tmp_path / "log"), str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)

    go()
    put(tmp_path / "in", "b.json", [{**EVENT, "event_id": f"e{i}", "timestamp": minute(i)} for i in range(5, 9)])
    go()
    go()
    read = ChainedLog(str(tmp_path / "log")).events(spark)
    assert audit.chain_report(read).first().asDict() == {"total": 9, "chained": 9, "unchained": 0, "failures": 0}
