"""Queries over DICOM files that are made from the rows of ``customer``: written, read again, released, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import dicom
from hushframe.queries import query, table
from hushframe.sources import dicom_files

_FILE = "concat('site', cast(c_nationkey % 5 as string), '/ward', cast(c_nationkey as string), '/', cast(c_custkey as string), '.dcm')"
_UID = "concat('1.2.3.', cast(c_custkey as string))"
_SYNTAX = f"CASE c_custkey % 3 WHEN 0 THEN '{dicom_files.EXPLICIT}' WHEN 1 THEN '{dicom_files.IMPLICIT}' ELSE '{dicom_files.BIG}' END"
_KEY = "cast(c_custkey as string)"

#: (sequence path, tag, vr, value as SQL or None) of the elements of a file, in order; items have the tag of items.
_ELEMENTS: tuple[tuple[str, str, str, str | None], ...] = (
    ("", "00020010", "UI", _SYNTAX),
    ("", "00080005", "CS", "'ISO_IR 192'"),
    ("", "00080016", "UI", "'1.2.840.10008.5.1.4.1.1.7'"),
    ("", "00080018", "UI", _UID),
    ("", "00080020", "DA", "'20260102'"),
    ("", "00080082", "SQ", None),
    ("00080082[0]/", dicom_files.ITEM, "", None),
    ("00080082[0]/", "00081030", "LO", f"concat('站', {_KEY})"),
    ("", "00081030", "LO", f"concat('CT ', {_KEY})"),
    ("", "00081115", "SQ", None),
    ("00081115[0]/", dicom_files.ITEM, "", None),
    ("00081115[0]/", "00081140", "SQ", None),
    ("00081115[0]/00081140[0]/", dicom_files.ITEM, "", None),
    ("00081115[0]/00081140[0]/", "00081155", "UI", _UID),
    ("00081115[0]/00081140[1]/", dicom_files.ITEM, "", None),
    ("00081115[0]/00081140[1]/", "00081155", "UI", "'1.2.3.0'"),
    ("", "00100010", "PN", "concat('王^', c_name)"),
    ("", "00100020", "LO", f"concat('ZY', {_KEY})"),
    ("", "00280010", "US", "cast(c_custkey % 4096 as string)"),
    ("", "00420010", "ST", "c_mktsegment"),
)
#: Action, and what a release makes of the value, of the elements that are not kept as they are.
_RELEASED = {"00080020": "''", "00081030": "''", "00100010": "''", "00100020": "''"}
_UIDS = ("00080018", "00081155")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' elements, every third sequence and item with an open length."""
    each = ", ".join(
        f"named_struct('place', {i}L, 'seq_path', '{path}', 'tag', '{tag}', 'vr', '{vr}', 'value', {'cast(null as string)' if value is None else value}, 'open', {f'c_custkey % 2 = {i % 2}' if value is None else 'false'})"
        for i, (path, tag, vr, value) in enumerate(_ELEMENTS)
    )
    rows = table(spark, sf_dir, "customer").selectExpr(f"{_FILE} AS file", f"inline(array({each}))")
    return rows.select("file", "place", "seq_path", "tag", "vr", F.lit("").alias("keyword"), "value", F.lit(False).alias("is_private"), F.lit(None).cast("binary").alias("raw"), "open")


def _read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dicom_files.elements(dicom_files.assemble(_rows(spark, sf_dir)), "file")


def _each_sql(columns: str, rows: list[tuple[str, str, str, str | None]]) -> str:
    return " UNION ALL ".join(f"SELECT {columns.format(path=path, tag=tag, vr=vr, value='NULL' if value is None else value)} FROM customer" for path, tag, vr, value in rows)


def _vr(tag: str, vr: str) -> str:
    """What the file says of an element; where representations are not written, those that no table lists are unknown."""
    return f"'{vr}'" if tag in dicom_files.REPRESENTATIONS or tag == dicom_files.ITEM else f"CASE WHEN c_custkey % 3 = 1 THEN 'UN' ELSE '{vr}' END"


def _value(tag: str, value: str | None) -> str | None:
    return value if value is None or tag in dicom_files.REPRESENTATIONS else f"CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE {value} END"


@query(" UNION ALL ".join(f"SELECT {_FILE} AS file, '{path}' AS seq_path, '{tag}' AS tag, {_vr(tag, vr)} AS vr, {_value(tag, value) or 'NULL'} AS value FROM customer" for path, tag, vr, value in _ELEMENTS))
def dicom_file_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements written to bytes in three encodings and read again."""
    return _read_again(spark, sf_dir).select("file", "seq_path", "tag", "vr", "value")


_KEPT = [e for e in _ELEMENTS if e[1] != "00080082" and not e[0].startswith("00080082")]


@query(
    " UNION ALL ".join(
        f"SELECT {_FILE} AS file, '{path}' AS seq_path, '{tag}' AS tag, " + ("NULL" if tag in _UIDS else _RELEASED.get(tag) or _value(tag, value) or "NULL") + f" AS value, {'true' if tag in _UIDS else 'false'} AS remapped FROM customer"
        for path, tag, vr, value in _KEPT
    )
)
def dicom_nested_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a release leaves of nested files; the removed sequence is gone with what it holds, and a UID is told only as remapped."""
    out = dicom.deidentify_nested(_read_again(spark, sf_dir), salt=b"fixed")
    again = dicom_files.elements(dicom_files.assemble(out), "file")
    remapped = F.coalesce(F.startswith("value", F.lit("2.25.")), F.lit(False))
    return again.select("file", "seq_path", "tag", F.when(~remapped, F.col("value")).alias("value"), remapped.alias("remapped"))


_ACTION = {"00020010": "uid_remapped", "00080016": "uid_remapped", "00080018": "uid_remapped", "00081155": "uid_remapped", "00080020": "date", "00080082": "removed", "00081030": "cleaned", "00100010": "emptied", "00100020": "emptied"}
_COUNTED = ", ".join(f"('{a}', {n})" for a, n in sorted({a: sum(_ACTION.get(t, "kept") == a for _, t, _, _ in _ELEMENTS if t != dicom_files.ITEM) for a in {*_ACTION.values(), "kept"}}.items()))


@query(
    f"""WITH files AS (SELECT {_FILE} AS file FROM customer), own AS (SELECT file, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS parts FROM files),
    above AS (SELECT file, unnest(range(0, len(parts) + 1)) AS depth, parts FROM own), counts(action, n) AS (VALUES {_COUNTED})
    SELECT array_to_string(parts[1:depth], '/') AS folder, depth::INT AS depth, action, count(*)::BIGINT AS files, sum(n)::BIGINT AS n FROM above, counts GROUP BY ALL"""
)
def dicom_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a release does, in total for each folder of the tree."""
    return dicom.tree_totals(dicom.actions_of(_read_again(spark, sf_dir)))
