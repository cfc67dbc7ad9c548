"""Splittable sources, dialect detection, dispatch by extension, and the result sink."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import stored
from ..errors import SourceError
from .csv_splits import STRUCTURE, csv_structure, parsed_records, plain_path, spanning_records
from .records import scan_dbf, scan_xlsx

JAVA_CHARSETS = {"utf-8": "UTF-8", "cp1251": "windows-1251", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}
DIALECT_COLUMNS = ["path", "encoding", "sep", "n_cols", "has_rows", "multi_line"]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below ``path`` without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path")


def _structures(paths: DataFrame) -> DataFrame:
    """Structure of every file; one without a line fits no dialect."""
    names = [r["path"] for r in paths.select("path").collect()]  # the readers need the list itself
    found = csv_structure(paths.sparkSession, names) if names else paths.sparkSession.createDataFrame([], STRUCTURE)
    every = paths.select("path").distinct().join(found, "path", "left")
    return every.withColumn("n_cols", F.coalesce("n_cols", F.lit(0))).withColumn("has_rows", F.coalesce("has_rows", F.lit(True))).withColumn(
        "multi_line", F.coalesce("multi_line", F.lit(False))
    )


def sniff_csv_dialects(paths: DataFrame) -> DataFrame:
    """``path, encoding, sep, n_cols, has_rows, multi_line`` per file, decided from all of its lines, block by block."""
    return _structures(paths).select(*DIALECT_COLUMNS)


# Quotes are doubled inside quoted text, and spaces belong to the text.
CSV_TEXT = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv_files(spark: SparkSession, paths: str | Sequence[str], encoding: str, sep: str, schema=None) -> DataFrame:
    """One read of files that share a dialect and have a record per line."""
    if encoding != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.options(**CSV_TEXT, sep=sep, encoding=JAVA_CHARSETS[encoding])
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def scan_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV of any supported dialect. Files of one dialect are read together, dialects are united by name.

    All files are read split, those too whose quoted fields hold line breaks.
    """
    # Hidden files are not data, and a file that is only a header adds no rows.
    found = _structures(list_files(spark, path).where("path NOT LIKE '%/\\_%' AND path NOT LIKE '%/.%'"))
    groups: dict[tuple, list] = {}
    for r in found.where("has_rows").toLocalIterator():
        if r["encoding"] is None:
            raise SourceError(f"no encoding and delimiter fits {r['path']}")
        groups.setdefault((r["encoding"], r["sep"], r["multi_line"]), []).append(r)
    if not groups:
        raise SourceError(f"no rows in {path}")
    parts = []
    for (encoding, sep, multi), files in sorted(groups.items()):
        names = [r["path"] for r in files]
        if multi:
            inside = {plain_path(r["path"]): set(r["inside"]) for r in files if r["inside"]}
            records = spanning_records(spark, names, encoding, sep, inside)
            parts.append(parsed_records(records, CSV_TEXT | {"sep": sep}, max(r["n_cols"] for r in files), schema))
        else:
            parts.append(read_csv_files(spark, path if len(groups) == 1 else names, encoding, sep, schema))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_json(spark: SparkSession, path: str, multi_line: bool | None = None, schema=None) -> DataFrame:
    """JSON lines, or one document per file: an array of rows, an object that is a row, or an object of columns.

    The form is decided for every file when ``multi_line`` is not given: a file is one document unless its first line
    is a complete object. A document ``{column: {row label: value}}`` becomes a row per label. Forms are united by name.
    """
    documents, lines = [path], []
    if multi_line is None:
        text = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
        heads = text.select(F.col("_metadata.file_path").alias("path"), place.alias("at"), "value")
        heads = heads.groupBy("path").agg(F.min_by("value", "at").alias("head"), F.count("*").alias("n")).collect()  # the readers need the list
        lines = [plain_path(r["path"]) for r in heads if _whole_object(r["head"])]
        documents = [plain_path(r["path"]) for r in heads if not _whole_object(r["head"]) or r["n"] == 1 and _holds_objects(r["head"])]
    elif not multi_line:
        documents, lines = [], [path]
    parts = []
    if documents:
        whole = spark.read.text(documents, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        members = F.from_json("value", "map<string,map<string,variant>>")
        labels = F.forall(F.map_values("m"), lambda x: x.isNotNull() & F.forall(F.map_keys(x), lambda k: k.rlike("^[0-9]+$")))
        shaped = whole.select("path", members.alias("m")).where((F.size("m") > 0) & labels)
        by_column = {plain_path(r["path"]) for r in shaped.select("path").collect()}
        lines = [p for p in lines if p not in by_column]
        if by_column:
            parts.append(_rows_of_columns(shaped, schema))
        documents = [p for p in documents if multi_line is None and p not in by_column and p not in lines or multi_line and not by_column]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if documents:
        parts.append(reader.option("multiLine", "true").json(documents))
    if lines or not parts:
        parts.append(reader.option("multiLine", "false").json(lines or path))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _rows_of_columns(documents: DataFrame, schema=None) -> DataFrame:
    """Rows of documents (path, m: column to label to value): cells are exploded and meet again by label."""
    cells = documents.select("path", F.explode("m").alias("column", "cells")).select("path", "column", F.explode("cells").alias("label", "value"))
    cells = stored(cells.select("path", "column", "label", F.expr("schema_of_variant(value)").alias("kind"), F.to_json("value").alias("value")), "json-cells")
    # One row per column and kind of value.
    kinds: dict[str, set[str]] = {}
    for r in cells.select("column", "kind").distinct().collect():
        kinds.setdefault(r["column"], set()).add(r["kind"].split("(")[0])
    if schema is not None:
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        types = {f.name: f.dataType.simpleString() for f in fields}
    else:
        types = {name: _column_type(found - {"VOID"}) for name, found in sorted(kinds.items())}
    # A cell is JSON text: read as an object of one member, whatever its type.
    def cell(name: str, kind: str) -> F.Column:
        return F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), f"v {kind}")["v"].alias(name)

    columns = [F.first(F.when(F.col("column") == n, cell(n, t)), ignorenulls=True).alias(n) for n, t in types.items()]
    return cells.groupBy("path", "label").agg(*columns).drop("path", "label")


def _column_type(kinds: set[str]) -> str:
    if kinds == {"BOOLEAN"}:
        return "boolean"
    if kinds == {"BIGINT"}:
        return "bigint"
    return "double" if kinds and kinds <= {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"} else "string"


def _whole_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _holds_objects(line: str) -> bool:
    """A document of columns may stand on one line."""
    found = json.loads(line)
    return bool(found) and all(isinstance(v, dict) for v in found.values())


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": scan_csv, "json": scan_json, "parquet": scan_parquet, "dbf": scan_dbf, "xlsx": scan_xlsx}


def load(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Read a file or directory; the lower-cased extension picks the reader, CSV if it is unknown."""
    kind = format or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    return READERS.get(kind, scan_csv)(spark, path)


def method_slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def write_results(flagged: DataFrame, base: str, method: str, format: str = "parquet") -> tuple[str, str]:
    """Write ``<base>_<method>_population`` and ``<base>_<method>_sample``; returns both paths."""
    population, sample = (f"{base}_{method_slug(method)}_{part}" for part in ("population", "sample"))
    options = CSV_TEXT if format == "csv" else {}
    # The selection is computed once; both tables come from the stored rows, never from a text file.
    rows = stored(flagged, "results") if format != "parquet" else flagged
    rows.write.mode("errorifexists").options(**options).format(format).save(population)
    if format == "parquet":
        rows = flagged.sparkSession.read.schema(flagged.schema).parquet(population)
    rows.where("is_sample = 1").write.mode("errorifexists").options(**options).format(format).save(sample)
    return population, sample
