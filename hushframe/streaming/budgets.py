"""Use budgets of approvals as keyed state of a stream, with revocations and expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and several states of a key need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EVENT = "grant_key string, kind string, seq long, at timestamp, uses_allowed long, expires_at timestamp"


class UseBudget(StatefulProcessor):
    """One grant: what it is bound to, the uses that were taken, and whether it was revoked.

    A use is committed when it is told and never given back.  A revocation is a
    tombstone: it may come before the first attempt, and holds until the grant's time is
    over.  The timer fires when the watermark passes the expiry; what is then left of the
    grant goes, for no attempt that could still use it is let through.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bound = handle.getValueState("bound", "uses_allowed long, expires_ms long")
        self.used = handle.getValueState("used", "n long")
        self.revoked = handle.getValueState("revoked", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802
        gone = self.revoked.exists()
        used = self.used.get()[0] if self.used.exists() else 0
        bound = tuple(self.bound.get()) if self.bound.exists() else None
        before = used
        # a revocation counts from its batch on, whatever its place there
        attempts = []
        for r in rows:
            if r.kind == "revoke":
                gone = True
                self.revoked.update((r.seq if r.seq is not None else -1,))
            else:
                attempts.append((r.seq, r.at, r.uses_allowed, r.expires_at))
        for seq, at, allowed, expires in sorted(attempts, key=lambda a: a[0]):
            ends = int(expires.replace(tzinfo=expires.tzinfo or timezone.utc).timestamp() * 1000)
            if at >= expires:
                outcome = "expired"
            elif gone:
                outcome = "revoked"
            elif bound is not None and bound != (allowed, ends):
                outcome = "conflict"
            else:
                if bound is None:
                    bound = (allowed, ends)
                    self.bound.update(bound)
                    self.handle.registerTimer(ends)
                outcome = "consumed" if used < allowed else "exhausted"
                used += outcome == "consumed"
            yield Row(grant_key=key[0], seq=seq, outcome=outcome, consumed=outcome == "consumed")
        if used != before:
            self.used.update((used,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802
        for state in (self.bound, self.used, self.revoked):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def consume_stream(attempts: DataFrame, revocations: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(grant_key, seq, outcome, consumed) of each attempt of a stream.

    ``attempts`` have grant_key, seq, at, uses_allowed and expires_at, ``revocations``
    grant_key and at; both are streams.  Outcomes: consumed, exhausted, expired, revoked,
    or conflict where a grant's budget or expiry is not what it was first.  Within a
    batch the attempts of a grant are taken by seq.  What is later than ``late`` behind the
    newest event is left out: it could meet a grant whose state is gone.  Attempts without a
    key, place, time or expiry are no attempts.  The session needs the state store ``ROCKSDB``.
    """
    use = attempts.where("grant_key is not null and seq is not null and at is not null and expires_at is not null and uses_allowed is not null")
    use = use.select("grant_key", F.lit("use").alias("kind"), F.col("seq").cast("long").alias("seq"), "at", F.col("uses_allowed").cast("long").alias("uses_allowed"), "expires_at")
    none = lambda t: F.lit(None).cast(t)
    revoke = revocations.where("grant_key is not null and at is not null").select("grant_key", F.lit("revoke").alias("kind"), none("long").alias("seq"), "at", none("long").alias("uses_allowed"), none("timestamp").alias("expires_at"))
    both = reduce(DataFrame.unionByName, [use, revoke]).withWatermark("at", late)
    return both.groupBy("grant_key").transformWithState(UseBudget(), "grant_key string, seq long, outcome string, consumed boolean", "Append", "EventTime")
