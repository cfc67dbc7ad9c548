"""Run registered queries beside their SQL and report differences.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float) and (v == 0 or math.isnan(v)):
        return 0.0 if v == 0 else "nan"
    return v


def spark_rows(df) -> tuple[list, list]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def duck_rows(db, sql: str) -> tuple[list, list]:
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_gaps(df, db, sql: str) -> list[str]:
    spark_types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
    duck = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    return [f"{n}: {t} / {duck.get(n)}" for n, t in spark_types.items() if t and duck.get(n) != t]


def compare(spark, db, sf_dir: str, query, sql: str | None) -> tuple[str, str]:
    df = query(spark, sf_dir)
    names, rows = spark_rows(df)
    if sql is None:
        return ("rows", f"{len(rows)} rows")
    wanted_names, wanted = duck_rows(db, sql)
    gaps = type_gaps(df, db, sql)
    if names != wanted_names:
        return "FAIL", f"columns {names} / {wanted_names}"
    if rows != wanted:
        odd = [(a, b) for a, b in zip(rows, wanted) if a != b]
        return "FAIL", f"{len(rows)} / {len(wanted)} rows, {len(odd)} differ, first {odd[:2]} {gaps}"
    return ("TYPES" if gaps else "ok"), f"{len(rows)} rows {gaps or ''}"


if __name__ == "__main__":
    from .oracles import ORACLES
    from .queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = session(os.environ.get("BENCH_CPUS", "8")), tables(sf)
    for name in sys.argv[2:] or QUERIES:
        at = time.time()
        try:
            status, note = compare(spark, db, sf, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # report and go on with the next query
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{status:6} {name} {time.time() - at:.1f}s {note}", flush=True)
