"""Labelled corpora, audit logs and tables of many files as DataFrames, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.spans import DOCUMENT_LEVEL
from hushframe.operators.audit import EVENT

VERDICTS = ("ALLOW", "SANITIZE", "ASK", "BLOCK")
SIDECAR = "doc_id string, document_type string, department string, expected_verdict string, spans array<struct<type:string,start:int,end:int>>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.spans\.json|\.txt)$", "")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def labelled_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, document_type, department, text, spans, expected_verdict, problem) of the sidecars of a folder, each joined to its text by stem.

    ``problem`` says why a document cannot be scored: no text, an unreadable
    sidecar, an unknown verdict, a bad or repeated id, or a span that is out of
    the text, repeated or of a document-level type.  Null where all is well.
    ``limit`` keeps the first documents by the names of their files.
    """
    sides = _files(spark, path, "*.spans.json").select(_stem(F.col("path")).alias("stem"), F.from_json("content", SIDECAR).alias("m"), (F.from_json("content", "map<string,string>")["spans"]).alias("raw"))
    texts = _files(spark, path, "*.txt").select(_stem(F.col("path")).alias("stem"), F.col("content").alias("text"))
    sides = sides if limit is None else sides.orderBy("stem").limit(limit)
    rows = sides.join(texts, "stem", "left").withColumn("doc_id", F.coalesce("m.doc_id", "stem"))
    same = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = rows.join(same, "doc_id")
    wrong = F.exists("m.spans", lambda s: s["type"].isNull() | (s["type"] == "") | s["type"].isin(*DOCUMENT_LEVEL) | s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length("text")))
    problem = (
        F.when(F.col("text").isNull(), "no text").when(F.col("m.spans").isNull() | F.col("raw").isNull(), "unreadable sidecar")
        .when(~F.coalesce(F.col("m.expected_verdict").isin(*VERDICTS), F.lit(False)), "unknown verdict")
        .when(F.col("doc_id").isin("", ".", "..") | F.col("doc_id").rlike(r"[/\\\x00]") | (F.col("n") > 1), "bad or repeated id")
        .when(F.coalesce(wrong, F.lit(True)), "bad span").when(F.size(F.array_distinct("m.spans")) < F.size("m.spans"), "repeated span")
    )
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return rows.select("doc_id", unknown(F.col("m.document_type")).alias("document_type"), unknown(F.col("m.department")).alias("department"), "text", F.col("m.spans").alias("spans"), F.col("m.expected_verdict").alias("expected_verdict"), problem.alias("problem"))


def read_lines_in_order(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, seq, line) of the lines of files; seq grows with the order of file names and of the lines in a file.

    Files are split as any text is: a line's place is its split's first byte and its number there,
    and a split has fewer lines than bytes.  What is told of splits and files is one row for each.
    """
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "split").agg(F.min("n").alias("first"))
    files = splits.select("file").distinct().withColumn("no", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    places = splits.join(F.broadcast(files), "file")
    seq = F.shiftleft("no", 44) + F.col("split") + F.col("n") - F.col("first")
    return rows.join(F.broadcast(places), ["file", "split"]).select("file", seq.alias("seq"), "line")


def read_events(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file, seq, event fields, broken) of the JSON-lines logs below a path, in one sequence over the files by name.

    Fields that a record lacks are null, as hashing needs it; a line that is no
    object is broken and has no fields.  Blank lines count in seq and give no row.
    """
    lines = read_lines_in_order(spark, path, pattern).where(F.trim("line") != "")
    told = lines.withColumn("e", F.from_json("line", EVENT))
    broken = F.col("e").isNull() | F.col("e.event_id").isNull()
    return told.select("file", "seq", "e.*", broken.alias("broken"))


def write_events(events: DataFrame, path: str) -> None:
    """A new folder of JSON lines; an existing one is never written over."""
    plain = events.select(F.to_json(F.struct(*events.columns)).alias("value"))
    plain.write.mode("errorifexists").option("compression", "none").text(path)


def duplicate_events(events: DataFrame) -> DataFrame:
    """(event_id, n) of the ids that more than one record has."""
    return events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


def write_released(rows: DataFrame, path: str, name: str = "doc_id", text: str = "sanitized") -> None:
    """Released texts only, a folder for each name; a folder that is there already is never written over."""
    rows.where("released").select(F.col(name).cast("string").alias("name"), F.col(text).alias("value")).write.mode("errorifexists").partitionBy("name").text(path)


def read_table_files(spark: SparkSession, path: str, columns: str, pattern: str = "*.csv") -> DataFrame:
    """(file, columns) of all rows of the CSV files below a path; a file whose header differs fails the read."""
    rows = spark.read.option("pathGlobFilter", pattern).csv(path, schema=columns, header=True, enforceSchema=False, mode="FAILFAST")
    return rows.select(F.col("_metadata.file_path").alias("file"), "*")
