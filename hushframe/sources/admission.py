"""What may enter: suffixes, binary guard, and the kind of a payload."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.sources.structured import kind_of_text

# File name suffixes that are never read as text.
REFUSED_SUFFIXES = "jsonl ndjson tsv xls xlsx xlsm ods pdf doc docx odt rtf xml hl7 dcm dicom bin zip gz png jpg jpeg gif tif tiff wav mp3 mp4".split()
# How documents begin that are no clinical prose.
DOCUMENT_HEADS = ("%PDF-", "{\\rtf", "<?xml", "<fhir:")


def is_binary(text: Column) -> Column:
    """Control characters other than tab and line ends, or the beginning of a document format."""
    head = F.regexp_replace(text, r"(?U)^\s+", "")
    magic = F.lit(False)
    for start in DOCUMENT_HEADS:
        magic = magic | F.startswith(head, F.lit(start))
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]") | magic


def refused_name(path: Column) -> Column:
    """True if any suffix of the file name is refused."""
    parts = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.")
    return F.size(F.array_intersect(F.slice(parts, 2, F.size(parts)), F.array(*map(F.lit, REFUSED_SUFFIXES)))) > 0


def kind_of(text: Column) -> Column:
    """json, fhir, text or unsupported.

    A text that begins with a brace or bracket is parsed in an Arrow kernel: SQL
    parsers refuse repeated keys and read past what follows a document.
    """

    @F.pandas_udf("string")
    def container(texts: pd.Series) -> pd.Series:
        return texts.map(kind_of_text, na_action="ignore")

    head = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.when(text.isNull() | is_binary(text), "unsupported").when(head.rlike(r"^[\{\[]"), container(text)).otherwise("text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, refused) of the files below a path: strict UTF-8, refused names and binary contents have no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(text, "^\\x{feff}", "")
    refused = refused_name(F.col("path")) | F.col("content").cast("string").isNull() | text.isNull()
    told = files.select("path", text.alias("text"), refused.alias("refused"))
    told = told.withColumn("refused", F.col("refused") | F.coalesce(is_binary(F.col("text")), F.lit(True)))
    return told.withColumn("text", F.when(~F.col("refused"), F.col("text")))
