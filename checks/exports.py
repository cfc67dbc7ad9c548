"""Writers for the two record formats, used only to produce files that the scans read back."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dbf_bytes(frame: pd.DataFrame, fields: list[tuple[str, str, int, int]]) -> bytes:
    """A dBASE III file; fields are (name, type letter, width, decimals)."""
    out = io.BytesIO()
    width = 1 + sum(f[2] for f in fields)
    out.write(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(frame), 33 + 32 * len(fields), width))
    for name, kind, size, decimals in fields:
        out.write(struct.pack("<11sc4xBB14x", name.encode("ascii"), kind.encode("ascii"), size, decimals))
    out.write(b"\r")
    for row in frame.itertuples(index=False):
        out.write(b" ")
        for value, (_, kind, size, decimals) in zip(row, fields):
            if value is None or value != value:
                text = ""
            elif kind == "N":
                text = f"{value:.{decimals}f}".rjust(size)
            else:
                text = str(value)
            out.write(text.encode("cp1252")[:size].ljust(size))
    out.write(b"\x1a")
    return out.getvalue()


def xlsx_bytes(frame: pd.DataFrame) -> bytes:
    """A workbook with one sheet of inline strings and numbers."""

    def cell(at: int, row: int, value) -> str:
        ref = f"{chr(65 + at)}{row}"
        if isinstance(value, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f'<c r="{ref}"><v>{value!r}</v></c>'

    lines = [frame.columns.tolist(), *frame.astype(object).to_numpy().tolist()]
    rows = "".join(
        f'<row r="{i}">' + "".join(cell(j, i, v) for j, v in enumerate(line) if v is not None) + "</row>"
        for i, line in enumerate(lines, 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def _write_groups(df: DataFrame, by: str, path: str, suffix: str, encode) -> None:
    """One file per value of ``by``, written by executors."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        store, folder = FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/part-{frame[by].iloc[0]}{suffix}") as f:
            f.write(encode(frame))
        return pd.DataFrame({"written": [len(frame)]})

    df.groupBy(by).applyInPandas(write, "written bigint").agg(F.sum("written")).collect()


def dbf_files(df: DataFrame, by: str, path: str) -> None:
    kinds = {T.LongType: ("N", 18, 0), T.IntegerType: ("N", 10, 0), T.DoubleType: ("N", 18, 2), T.StringType: ("C", 60, 0)}
    fields = [(f.name, *kinds[type(f.dataType)]) for f in df.schema]
    _write_groups(df, by, path, ".dbf", lambda frame: dbf_bytes(frame, fields))


def xlsx_files(df: DataFrame, by: str, path: str) -> None:
    _write_groups(df, by, path, ".xlsx", xlsx_bytes)
