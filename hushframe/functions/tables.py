"""Table functions for SQL: leaves of payloads, and spans merged partition by partition.

    SELECT t.id, x.* FROM t, LATERAL hf_leaves(t.kind, t.content) AS x
    SELECT * FROM hf_merge_spans(TABLE(spans) PARTITION BY doc_id ORDER BY (start, `end` DESC))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from hushframe.functions.spans import DOCUMENT_LEVEL
from hushframe.sources.structured import leaves_of, placed


@udtf(returnType="ord int, path string, text string, probes array<string>, read_only boolean, start int, problem string")
class Leaves:
    """The leaves of a payload of kind json, csv, fhir or text, in order; a payload that cannot be read has one row with its problem."""

    def eval(self, kind: str, content: str) -> Iterator[tuple]:
        try:
            for i, leaf in enumerate(placed(leaves_of(kind, content or ""))):
                yield i, leaf["path"], leaf["text"], leaf["probes"], leaf["read_only"], leaf["start"], None
        except (ValueError, RecursionError) as e:
            yield None, None, None, None, None, None, str(e) if str(e) in ("PARSER_FAILURE", "UNSUPPORTED_FORMAT") else "PARSER_FAILURE"


@udtf(returnType="doc_id string, type string, start int, end int, confidence double")
class MergeSpans:
    """Spans (doc_id, type, start, end, confidence) of one partition in order of start and falling end, of which overlapping ones compete.

    The last one kept is all that is held, however long a document is.
    """

    def __init__(self) -> None:
        self.last: tuple | None = None

    @staticmethod
    def _rank(span: tuple) -> tuple:
        _, kind, start, end, sure = span
        return kind not in DOCUMENT_LEVEL, sure, end - start

    def eval(self, row: Row) -> Iterator[tuple]:
        span = str(row["doc_id"]), row["type"], int(row["start"]), int(row["end"]), float(row["confidence"])
        if self.last is None:
            self.last = span
        elif span[2] >= self.last[3]:
            yield self.last
            self.last = span
        elif self._rank(span) > self._rank(self.last):
            self.last = span

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield self.last


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session."""
    spark.udtf.register("hf_leaves", Leaves)
    spark.udtf.register("hf_merge_spans", MergeSpans)
