"""Ingest of many small DBF or XLSX files: one file per row, decoded inside tasks.

A directory is one table; the first file gives the schema, and every file is read on
an executor. These formats cannot be split, so parallelism is the number of files.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).where(F.lower("path").endswith(suffix))


def _first(files: DataFrame, path: str) -> bytes:
    one = files.select("path").orderBy("path").limit(1)
    row = files.join(one, "path", "left_semi").select("content").first()
    if row is None:
        raise SourceError(f"no file to read below {path}")
    return bytes(row["content"])


# dBASE: type letter -> Spark type. Memo text lives in a side file and reads as null.
DBF_TYPES = {
    "C": T.StringType(), "N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(),
    "D": T.DateType(), "I": T.IntegerType(), "M": T.StringType(), "T": T.TimestampNTZType(), "Y": T.DoubleType(),
}
JULIAN_1970 = 2_440_588
# Language byte of the header -> code page.
CODE_PAGES = {
    0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x26: "cp866", 0x57: "cp1252", 0x58: "cp1252", 0x64: "cp852",
    0x65: "cp866", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253",
}


def dbf_fields(content: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type letter, width, decimals) from the header's 32-byte descriptors."""
    fields, at = [], 32
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("ascii")
        fields.append((name, chr(content[at + 11]), content[at + 16], content[at + 17]))
        at += 32
    return fields


def dbf_type(kind: str, width: int, decimals: int) -> T.DataType:
    if kind in "NF" and decimals == 0 and width <= 18:
        return T.LongType()
    return DBF_TYPES.get(kind, T.StringType())


def padded(values: np.ndarray, width: int) -> bytes:
    """The raw bytes of a binary field; numpy strips trailing zeros of single values, not of the array."""
    return np.ascontiguousarray(values).astype(f"S{width}").tobytes()


def same_columns(frame: pd.DataFrame, schema: T.StructType, path: str) -> None:
    """Refuse a file whose columns are not those of the first one: nothing is dropped or filled in."""
    if list(frame.columns) != schema.names:
        odd = sorted(set(frame.columns) ^ set(schema.names)) or list(frame.columns)
        raise SourceError(f"{path}: columns differ from the first file's: {odd}")


def whole(converted: pd.Series, given: pd.Series, path: str) -> pd.Series:
    """``converted``, unless a value was lost in conversion."""
    lost = converted.isna() & given.notna() & (given.astype(str).str.strip() != "")
    if lost.any():
        raise SourceError(f"{path}: {given[lost].iloc[0]!r} in {given.name} does not fit the first file's type; give a schema")
    return converted


def dbf_frame(content: bytes, encoding: str | None = None) -> pd.DataFrame:
    """Live records of one file, decoded column by column from fixed-width bytes."""
    encoding = encoding or CODE_PAGES.get(content[29], "cp1252")
    count, header, width = struct.unpack("<IHH", content[4:12])
    fields = dbf_fields(content)
    layout = np.dtype([("gone", "S1"), *[(f"f{i}", f"S{f[2]}") for i, f in enumerate(fields)]])
    if layout.itemsize != width:
        raise SourceError("record width does not match the field widths")
    records = np.frombuffer(content, layout, count, header)
    records = records[records["gone"] != b"*"]
    out = {}
    for i, (name, kind, size, decimals) in enumerate(fields):
        raw = pd.Series(records[f"f{i}"])
        if kind not in "ITYM":
            text = raw.map(lambda b: b.decode(encoding).strip(" \0"))
        if kind == "I":
            out[name] = pd.Series(np.frombuffer(padded(records[f"f{i}"], 4), "<i4")).astype("Int32")
        elif kind in "NF":
            # Unfilled fields hold spaces, overflown ones asterisks.
            number = whole(pd.to_numeric(text.replace("", None), errors="coerce"), text.mask(text.str.fullmatch(r"\*+")), name)
            out[name] = number.astype("Int64" if dbf_type(kind, size, decimals) == T.LongType() else "float64")
        elif kind == "L":
            out[name] = text.map(lambda v: True if v in tuple("YyTt") else False if v in tuple("NnFf") else None)
        elif kind == "D":
            out[name] = pd.to_datetime(text, format="%Y%m%d", errors="coerce").dt.date
        elif kind == "T":
            days, ms = np.frombuffer(padded(records[f"f{i}"], 8), "<i4").reshape(-1, 2).T
            since = np.where(days > 0, days.astype("i8") - JULIAN_1970, 0)
            when = pd.to_datetime(since * 86_400_000 + ms, unit="ms")
            out[name] = pd.Series(when).where(days > 0)
        elif kind == "Y":
            out[name] = pd.Series(np.frombuffer(padded(records[f"f{i}"], 8), "<i8") / 10_000)
        elif kind == "M":
            out[name] = pd.Series([None] * len(records), dtype=object)
        else:
            out[name] = text
    return pd.DataFrame(out)


def scan_dbf(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Every DBF file below ``path``; text in the file's own code page unless one is given."""
    files = _files(spark, path, ".dbf")
    schema = T.StructType([T.StructField(n, dbf_type(k, w, d)) for n, k, w, d in dbf_fields(_first(files, path))])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                frame = dbf_frame(bytes(content), encoding)
                same_columns(frame, schema, path)
                yield frame

    return files.select("path", "content").mapInPandas(decode, schema)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = pd.Timestamp("1899-12-30")


def _first_sheet(book: zipfile.ZipFile) -> str:
    """Part name of the first sheet in workbook order."""
    names = book.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"))
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if link.get("Id") == first.get(RELATION):
                target = link.get("Target")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return min(sheets, key=lambda n: int(re.search(r"\d+", n).group()))


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """Cell style numbers that format a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")) for f in root.iter(f"{SHEET}numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    cells = root.find(f"{SHEET}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in cells] if cells is not None else []
    return {str(i) for i, f in enumerate(formats) if f in DATE_FORMATS or f in custom}


def _cell(cell, shared: list[str], dates: set[str]):
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    value = cell.find(f"{SHEET}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "e"):
        return value.text if kind == "str" else None
    if kind is None and cell.get("s") in dates:
        return EPOCH + pd.Timedelta(round(float(value.text) * 86_400_000), "ms")
    return float(value.text)


def xlsx_frame(content: bytes) -> pd.DataFrame:
    """First sheet of a workbook; its first row names the columns."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in root.iter(f"{SHEET}si")]
        dates = _date_styles(book)
        rows = []
        for row in ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{SHEET}row"):
            cells = {_column_index(c.get("r")): _cell(c, shared, dates) for c in row.iter(f"{SHEET}c")}
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    if not rows:
        return pd.DataFrame()
    header = [str(h) for h in rows[0]]
    body = [(r + [None] * len(header))[: len(header)] for r in rows[1:]]
    return pd.DataFrame(body, columns=header, dtype=object)


def _xlsx_type(values: pd.Series) -> T.DataType:
    kinds = {type(v) for v in values.dropna()}
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {float}:
        return T.DoubleType()
    if kinds == {pd.Timestamp}:
        return T.TimestampNTZType()
    return T.StringType()


def scan_xlsx(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Numbers read as double, mixed columns as text; the schema comes from the first file unless given."""
    files = _files(spark, path, ".xlsx")
    if schema is None:
        sample = xlsx_frame(_first(files, path))
        schema = T.StructType([T.StructField(c, _xlsx_type(sample[c])) for c in sample.columns])

    def as_text(v):
        if v is None or isinstance(v, str):
            return v
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                frame = xlsx_frame(bytes(content))
                same_columns(frame, schema, path)
                for field in schema.fields:
                    if isinstance(field.dataType, T.StringType):
                        frame[field.name] = frame[field.name].map(as_text)
                    elif isinstance(field.dataType, T.TimestampNTZType):
                        frame[field.name] = whole(pd.to_datetime(frame[field.name], errors="coerce"), frame[field.name], path)
                    elif isinstance(field.dataType, T.DoubleType):
                        frame[field.name] = whole(pd.to_numeric(frame[field.name], errors="coerce"), frame[field.name], path)
                yield frame

    return files.select("path", "content").mapInPandas(decode, schema)
