"""DICOM files as rows of elements, and back: tag, length and value, nested sequences, three encodings.

``scan`` reads files through Spark's own binary reader, so that they may lie in any store, and
turns each into one row for each element, in order.  ``assemble`` is its inverse: an
unchanged file comes back byte for byte (a deflated one element for element).  A file is the
unit of both: it is read by one task, element by element.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from hushframe.operators.dicom import DISPOSITIONS

# The encodings of a data set (explicit VR, big endian, deflated) by transfer syntax.
IMPLICIT, EXPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
# Value representations with lengths of four bytes, texts, and numbers with their formats.
LONG = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV")
TEXTS = ("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT")
LOCAL = ("LO", "LT", "PN", "SH", "ST", "UC", "UT")
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
# Character sets by their defined terms.
CHARSETS = {"ISO_IR 100": "latin-1", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk", "ISO_IR 13": "shift_jis", "ISO_IR 144": "iso8859_5"}
# Elements that the disposition table does not name but files commonly hold.
COMMON = (
    ("00020000", "FileMetaInformationGroupLength", "UL"),
    ("00020001", "FileMetaInformationVersion", "OB"),
    ("00020002", "MediaStorageSOPClassUID", "UI"),
    ("00020003", "MediaStorageSOPInstanceUID", "UI"),
    ("00020010", "TransferSyntaxUID", "UI"),
    ("00080005", "SpecificCharacterSet", "CS"),
    ("00080016", "SOPClassUID", "UI"),
    ("00080018", "SOPInstanceUID", "UI"),
    ("00080020", "StudyDate", "DA"),
    ("00080030", "StudyTime", "TM"),
    ("00080060", "Modality", "CS"),
    ("00081115", "ReferencedSeriesSequence", "SQ"),
    ("00081140", "ReferencedImageSequence", "SQ"),
    ("00081155", "ReferencedSOPInstanceUID", "UI"),
    ("00100010", "PatientName", "PN"),
    ("00100020", "PatientID", "LO"),
    ("00100030", "PatientBirthDate", "DA"),
    ("00100040", "PatientSex", "CS"),
    ("0020000D", "StudyInstanceUID", "UI"),
    ("0020000E", "SeriesInstanceUID", "UI"),
    ("00200013", "InstanceNumber", "IS"),
    ("00280010", "Rows", "US"),
    ("00280011", "Columns", "US"),
    ("00280301", "BurnedInAnnotation", "CS"),
    ("00420011", "EncapsulatedDocument", "OB"),
    ("7FE00010", "PixelData", "OW"),
)
KEYWORDS = {tag: keyword for tag, keyword, _ in DISPOSITIONS} | {tag: keyword for tag, keyword, _ in COMMON}
REPRESENTATIONS = {tag: "SQ" if keyword.endswith("Sequence") else "PN" if keyword.endswith("PhysicianName") else "LO" for tag, keyword, _ in DISPOSITIONS} | {tag: vr for tag, _, vr in COMMON}

ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = "FFFEE000", "FFFEE00D", "FFFEE0DD", 0xFFFFFFFF

#: Columns of an element: those of ``operators.dicom.ELEMENT``, its place in the file, its bytes, and whether its length is open.
ELEMENTS = "file string, place long, seq_path string, tag string, vr string, keyword string, value string, is_private boolean, raw binary, open boolean"
_NAMES = [f.split()[0] for f in ELEMENTS.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.bool_()]


class NotDicom(ValueError):
    """The bytes are no DICOM file, or end too early."""


class _Codec:
    """One encoding: how tags, lengths, numbers and texts are written."""

    def __init__(self, syntax: str, charset: str = "") -> None:
        self.explicit, self.order = syntax != IMPLICIT, ">" if syntax == BIG else "<"
        self.text = CHARSETS.get(charset.split("\\")[-1].strip(), "latin-1")

    def shown(self, vr: str, raw: bytes) -> str | None:
        if vr in TEXTS:
            return raw.decode(self.text if vr in LOCAL else "latin-1", "replace").rstrip(" \0")
        if vr in NUMBERS:
            size = struct.calcsize(NUMBERS[vr])
            return "\\".join(str(x) for x in struct.unpack(f"{self.order}{len(raw) // size}{NUMBERS[vr]}", raw[: len(raw) // size * size]))
        return None

    def written(self, vr: str, value: str) -> bytes:
        if vr in NUMBERS:
            number = float if vr in ("FL", "FD") else int
            return b"".join(struct.pack(self.order + NUMBERS[vr], number(x)) for x in value.split("\\") if x)
        raw = value.encode(self.text if vr in LOCAL else "latin-1", "replace")
        return raw + (b"\0" if vr == "UI" else b" ") * (len(raw) % 2)

    def head(self, tag: str, vr: str, length: int) -> bytes:
        start = struct.pack(self.order + "HH", int(tag[:4], 16), int(tag[4:], 16))
        if tag[:4] == "FFFE" or not self.explicit:
            return start + struct.pack(self.order + "I", length)
        if vr in LONG:
            return start + vr.encode() + b"\0\0" + struct.pack(self.order + "I", length)
        return start + vr.encode() + struct.pack(self.order + "H", length)


class _Reader:
    """Walks the elements of one file."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.rows = data, 0, []

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise NotDicom("the file ends within an element")
        self.at += n
        return self.data[self.at - n : self.at]

    def head(self, c: _Codec) -> tuple[str, str, int]:
        group, element = struct.unpack(c.order + "HH", self.take(4))
        tag = f"{group:04X}{element:04X}"
        if tag[:4] == "FFFE" or not c.explicit:
            length = struct.unpack(c.order + "I", self.take(4))[0]
            return tag, REPRESENTATIONS.get(tag, "SQ" if length == UNDEFINED else "UL" if element == 0 else "UN"), length
        vr = self.take(2).decode("latin-1")
        if vr in LONG:
            return tag, vr, struct.unpack(c.order + "I", self.take(6)[2:])[0]
        return tag, vr, struct.unpack(c.order + "H", self.take(2))[0]

    def put(self, path: str, tag: str, vr: str, value: str | None, raw: bytes | None, open_: bool) -> None:
        self.rows.append((len(self.rows), path, tag, vr, KEYWORDS.get(tag, ""), value, int(tag[3], 16) % 2 == 1 and tag[:4] != "FFFE", raw, open_))

    def elements(self, c: _Codec, path: str, end: int, until: str = "") -> None:
        """Elements up to a place, or to the delimiter ``until``."""
        while self.at < end:
            tag, vr, length = self.head(c)
            if until and tag == until:
                return
            if vr == "SQ" or (vr == "UN" and length == UNDEFINED):
                self.put(path, tag, vr, None, None, length == UNDEFINED)
                self.items(_Codec(IMPLICIT) if vr == "UN" else c, f"{path}{tag}", end if length == UNDEFINED else self.at + length, length == UNDEFINED)
            elif length == UNDEFINED:  # fragments of encapsulated pixels
                start = self.at
                while True:
                    item, _, size = self.head(c)
                    if item == SEQUENCE_END:
                        break
                    self.take(size)
                self.put(path, tag, vr, None, self.data[start : self.at], True)
            else:
                raw = self.take(length)
                if tag == "00080005":
                    c.text = _Codec(EXPLICIT, raw.decode("latin-1")).text
                self.put(path, tag, vr, c.shown(vr, raw), raw, False)
        if until:
            raise NotDicom("an item or a sequence is not closed")

    def items(self, c: _Codec, path: str, end: int, open_: bool) -> None:
        n = 0
        while self.at < end:
            tag, _, length = self.head(c)
            if tag == SEQUENCE_END:
                return
            if tag != ITEM:
                raise NotDicom("a sequence holds something else than items")
            inner = f"{path}[{n}]/"
            self.put(inner, ITEM, "", None, None, length == UNDEFINED)
            self.elements(c, inner, end if length == UNDEFINED else self.at + length, ITEM_END if length == UNDEFINED else "")
            n += 1
        if open_:
            raise NotDicom("an item or a sequence is not closed")


def parse(data: bytes) -> list[tuple]:
    """The elements of a file, without its name: place, seq_path, tag, vr, keyword, value, is_private, raw, open."""
    if data[128:132] != b"DICM":
        raise NotDicom("no DICOM marker")
    reader, meta = _Reader(data), _Codec(EXPLICIT)
    reader.at = 132
    while data[reader.at : reader.at + 2] == b"\2\0":
        tag, vr, length = reader.head(meta)
        raw = reader.take(length)
        reader.put("", tag, vr, meta.shown(vr, raw), raw, False)
    syntax = next((r[5] for r in reader.rows if r[2] == "00020010"), IMPLICIT)
    if syntax == DEFLATED:
        try:
            reader.data, reader.at = zlib.decompress(data[reader.at :], -15), 0
        except zlib.error as e:
            raise NotDicom("the data set cannot be inflated") from e
    reader.elements(_Codec(syntax), "", len(reader.data))
    return reader.rows


def build(rows: list[dict]) -> bytes:
    """A file of elements in order; the length of the meta group, and of what is not open, follows from what is there."""
    syntax = next((r["value"] for r in rows if r["tag"] == "00020010"), IMPLICIT)
    charset = next((r["value"] or "" for r in rows if r["tag"] == "00080005"), "")
    meta, body = _Codec(EXPLICIT), _Codec(syntax, charset)

    def value_of(r: dict, c: _Codec) -> bytes:
        raw = r["raw"]
        if r["value"] is None or (raw is not None and c.shown(r["vr"], raw) == r["value"]):
            return raw or b""
        return c.written(r["vr"], r["value"])

    def level(at: int, path: str, c: _Codec) -> tuple[bytes, int]:
        """The elements that lie at ``path`` from row ``at`` on."""
        out = []
        while at < len(rows) and rows[at]["seq_path"] == path and rows[at]["tag"] != ITEM:
            r = rows[at]
            if r["vr"] == "SQ" or (r["vr"] == "UN" and r["open"] and r["raw"] is None):
                inside, at = items(at + 1, f"{path}{r['tag']}", c if r["vr"] == "SQ" else _Codec(IMPLICIT, charset))
                inside += c.head(SEQUENCE_END, "", 0) if r["open"] else b""
                out.append(c.head(r["tag"], r["vr"], UNDEFINED if r["open"] else len(inside)) + inside)
                continue
            raw = value_of(r, c)
            out.append(c.head(r["tag"], r["vr"], UNDEFINED if r["open"] else len(raw)) + raw)
            at += 1
        return b"".join(out), at

    def items(at: int, path: str, c: _Codec) -> tuple[bytes, int]:
        out = []
        while at < len(rows) and rows[at]["tag"] == ITEM and rows[at]["seq_path"].startswith(f"{path}[") and rows[at]["seq_path"].count("/") == path.count("/") + 1:
            r = rows[at]
            inside, at = level(at + 1, r["seq_path"], c)
            inside += c.head(ITEM_END, "", 0) if r["open"] else b""
            out.append(c.head(ITEM, "", UNDEFINED if r["open"] else len(inside)) + inside)
        return b"".join(out), at

    first = next((i for i, r in enumerate(rows) if r["tag"][:4] != "0002"), len(rows))
    group = b"".join(meta.head(r["tag"], r["vr"], len(value_of(r, meta))) + value_of(r, meta) for r in rows[:first] if r["tag"] != "00020000")
    data, end = level(first, "", body)
    if end != len(rows):
        raise ValueError("an element lies outside of its sequence")
    if syntax == DEFLATED:
        squeeze = zlib.compressobj(wbits=-15)
        data = squeeze.compress(data) + squeeze.flush()
        data += b"\0" * (len(data) % 2)
    lead = meta.head("00020000", "UL", 4) + struct.pack("<I", len(group)) if any(r["tag"] == "00020000" for r in rows[:first]) else b""
    return bytes(128) + b"DICM" + lead + group + data


def elements(files: DataFrame, file: str = "path", content: str = "content") -> DataFrame:
    """Element rows of (file, content) rows; a file that cannot be read has one row, with its reason as ``value`` and no tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = parse(data.as_py() or b"")
                except (NotDicom, struct.error, RecursionError) as e:
                    rows = [(0, "", None, None, "", str(e) or "unreadable", False, None, False)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((name, *r) for r in rows)), _TYPES)], names=_NAMES)

    return files.select(F.col(file).alias("file"), F.col(content).alias("content")).mapInArrow(run, ELEMENTS)


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Element rows of the files below a path, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return elements(files)


def skipped(rows: DataFrame) -> DataFrame:
    """(file, reason) of what is no DICOM file."""
    return rows.where("tag is null").select("file", F.col("value").alias("reason"))


def assemble(rows: DataFrame) -> DataFrame:
    """(file, content) of element rows; changed values are encoded anew, what is gone is left out, readable files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]["file"]], pa.string()), pa.array([build(held)], pa.binary())], names=["file", "content"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["file"] != r["file"]:
                    yield out()
                    held.clear()
                held.append(r)
        if held:
            yield out()

    dealt = rows.where("tag is not null").select(*_NAMES).repartition("file").sortWithinPartitions("file", "place")
    return dealt.mapInArrow(run, "file string, content binary")


class FilesWriter(DataSourceWriter):
    """Writes (file, content) rows as files below a path that all executors share; a failed job leaves none."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        made = []
        for row in iterator:
            target = os.path.normpath(os.path.join(self.path, row["file"].lstrip("/")))
            if not target.startswith(os.path.normpath(self.path) + os.sep):
                raise ValueError("a file's name leads out of the folder")
            if os.path.exists(target):
                raise FileExistsError(target)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.urandom(8).hex()}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            made.append((part, target))
        message = WriterCommitMessage()
        message.made = made
        return message

    def commit(self, messages: list) -> None:
        for message in messages:
            for part, target in message.made:
                os.rename(part, target)

    def abort(self, messages: list) -> None:
        for message in messages:
            for part, _ in message.made if message is not None else ():
                if os.path.exists(part):
                    os.unlink(part)


class BinaryFiles(DataSource):
    """``df.write.format("binary_files")`` of (file, content) rows."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """(file, content) rows as files below ``path``, which all executors share; a file that is there is never written over."""
    files.sparkSession.dataSource.register(BinaryFiles)
    files.select("file", "content").write.format("binary_files").mode("append").save(path)
