"""DICOM files: bytes to elements and back, sequences, release, totals."""

import struct

import pytest
from pyspark.sql import functions as F

from hushframe.operators import dicom
from hushframe.sources import dicom_files as D


def row(path, tag, vr, value=None, raw=None, open_=False):
    return {"seq_path": path, "tag": tag, "vr": vr, "value": value, "raw": raw, "open": open_}


def sample(syntax, open_, name="张^伟"):
    seq = "00081115"
    return [
        row("", "00020000", "UL", "0"), row("", "00020002", "UI", "1.2.840.10008.5.1.4.1.1.7"), row("", "00020010", "UI", syntax),
        row("", "00080005", "CS", "ISO_IR 192"), row("", "00080016", "UI", "1.2.840.10008.5.1.4.1.1.7"), row("", "00080018", "UI", "1.2.3.4.5"),
        row("", "00080020", "DA", "20260102"), row("", "00080082", "SQ", open_=open_), row("00080082[0]/", D.ITEM, "", open_=open_), row("00080082[0]/", "00081030", "LO", "inside what goes"),
        row("", "00081030", "LO", "CT of Alice, mail a@b.example.com"),
        row("", seq, "SQ", open_=open_), row(f"{seq}[0]/", D.ITEM, "", open_=open_), row(f"{seq}[0]/", "0020000E", "UI", "1.2.3.9"),
        row(f"{seq}[0]/", "00081140", "SQ", open_=not open_), row(f"{seq}[0]/00081140[0]/", D.ITEM, "", open_=open_), row(f"{seq}[0]/00081140[0]/", "00081155", "UI", "1.2.3.4.5"),
        row(f"{seq}[0]/00081140[1]/", D.ITEM, "", open_=not open_), row(f"{seq}[1]/", D.ITEM, "", open_=open_),
        row("", "00100010", "PN", name), row("", "00100020", "LO", "ZY1"), row("", "00280010", "US", "512"), row("", "7FE00010", "OW", None, b"\x01\x02\x03\x04"),
    ]


@pytest.mark.parametrize("syntax", [D.IMPLICIT, D.EXPLICIT, D.BIG, D.DEFLATED])
@pytest.mark.parametrize("open_", [True, False])
def test_round_trip(syntax, open_):
    rows = sample(syntax, open_)
    data = D.build(rows)
    told = [dict(zip(("place", "seq_path", "tag", "vr", "keyword", "value", "is_private", "raw", "open"), r)) for r in D.parse(data)]
    assert [(r["seq_path"], r["tag"], r["vr"], r["open"]) for r in told] == [(r["seq_path"], r["tag"], r["vr"], r["open"]) for r in rows]
    assert [r["value"] for r in told[1:-1]] == [r["value"] for r in rows[1:-1]] and told[-1]["raw"] == b"\x01\x02\x03\x04"
    assert D.build(told) == data
    changed = [{**r, "value": "李"} if r["tag"] == "00100010" else r for r in told]
    again = {r[2]: r[5] for r in D.parse(D.build(changed))}
    assert again["00100010"] == "李" and again["00100020"] == "ZY1"


def test_encapsulated_pixels_stay_as_they_are():
    fragments = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, 4) + b"abcd" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    data = D.build([row("", "00020010", "UI", D.EXPLICIT), row("", "7FE00010", "OB", None, fragments, True)])
    told = D.parse(data)
    assert told[1][7] == fragments
    assert D.build([dict(zip(("place", "seq_path", "tag", "vr", "keyword", "value", "is_private", "raw", "open"), r)) for r in told]) == data


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "in" / "a" / "b").mkdir(parents=True)
    good = D.build(sample(D.EXPLICIT, True))
    (tmp_path / "in" / "a" / "1.dcm").write_bytes(good)
    (tmp_path / "in" / "a" / "b" / "2.dcm").write_bytes(D.build(sample(D.IMPLICIT, False)))
    (tmp_path / "in" / "note.txt").write_bytes(b"no image")
    (tmp_path / "in" / "cut.dcm").write_bytes(good[:-7])
    rows = D.scan(spark, str(tmp_path / "in"))
    root = rows.select("file").first()["file"].split("/in/")[0] + "/in/"
    rows = rows.withColumn("file", F.replace("file", F.lit(root), F.lit("")))
    assert {r["file"]: r["reason"] for r in D.skipped(rows).collect()} == {"note.txt": "no DICOM marker", "cut.dcm": "the file ends within an element"}
    rows = rows.where("tag is not null")
    D.write_files(D.assemble(rows), str(tmp_path / "same"))
    assert (tmp_path / "same" / "a" / "1.dcm").read_bytes() == good
    with pytest.raises(Exception, match="1.dcm|exist"):
        D.write_files(D.assemble(rows), str(tmp_path / "same"))
    # released: the removed sequence takes what it holds with it, names and texts go, links between files hold
    out = dicom.deidentify_nested(dicom.guard_texts(rows), cleaned=F.col("cleaned"), salt=b"s")
    D.write_files(D.assemble(out), str(tmp_path / "out"))
    assert dicom.survivors(rows, out).count() == 0
    told = {(r[1], r[2]): r[5] for r in D.parse((tmp_path / "out" / "a" / "1.dcm").read_bytes())}
    assert ("", "00080082") not in told and ("00080082[0]/", "00081030") not in told and told["", "00100010"] == ""
    assert told["", "00080018"] == told["00081115[0]/00081140[0]/", "00081155"] and told["", "00080018"].startswith("2.25.")
    assert "example.com" not in told["", "00081030"] and told["", "00080020"] == ""
    assert dicom.refusals(rows).collect() == []


def test_totals_of_a_tree(spark):
    counts = spark.createDataFrame([("a/b/1", "kept", 2), ("a/b/2", "kept", 3), ("a/3", "kept", 1), ("a/3", "removed", 5), ("4", "kept", 7)], "file string, action string, n long")
    told = {(r["folder"], r["action"]): (r["depth"], r["files"], r["n"]) for r in dicom.tree_totals(counts).collect()}
    assert told == {("", "kept"): (0, 4, 13), ("", "removed"): (0, 1, 5), ("a", "kept"): (1, 3, 6), ("a", "removed"): (1, 1, 5), ("a/b", "kept"): (2, 2, 5)}
    assert dicom.tree_totals(counts.where("false")).collect() == []


def test_what_must_not_be_released(spark):
    rows = spark.createDataFrame([("a", "", "00280301", "yes "), ("b", "", "00420011", None), ("c", "", "00280301", "NO"), ("d", "", "00080016", "1.2.840.10008.5.1.4.1.1.104.1")], "file string, seq_path string, tag string, value string")
    assert {r["file"]: r["reason"] for r in dicom.refusals(rows).collect()} == {"a": "burned-in annotation", "b": "encapsulated document", "d": "encapsulated document"}
    assert {r["file"] for r in dicom.refusals(rows, allow_burned_in=True).collect()} == {"b", "d"}
