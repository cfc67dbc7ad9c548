"""Helpers that decide where small tables and intermediate results live."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ColumnError, RowLimitError, SampleSizeError, SharedFolderError

# Largest table that may be broadcast; beyond it joins shuffle both sides.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnError(f"columns not found: {missing}")


def require_size(n: int) -> None:
    if n < 1:
        raise SampleSizeError(f"sample size must be positive, got {n}")


def require_rows(df: DataFrame, max_rows: int | None) -> None:
    """Refuse a population above ``max_rows``; counts no further than the limit."""
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise RowLimitError(f"population exceeds {max_rows} rows")


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a summary table once; broadcast it only if it has at most ``max_rows`` rows and ``BROADCAST_BYTES``.

    Above the limit the table stays distributed and later joins shuffle, so the
    size of what is broadcast is always checked.
    """
    arrays = any(f.dataType.typeName() == "array" for f in df.schema)  # their width shows in the rows only
    few = df.limit(1_000).toArrow() if arrays else None
    if few is not None and few.num_rows and few.nbytes / few.num_rows * max_rows > BROADCAST_BYTES:
        max_rows = max(1, int(BROADCAST_BYTES * few.num_rows / few.nbytes))
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > BROADCAST_BYTES:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema)), True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise SharedFolderError("set spark.checkpoint.dir to a folder that all executors share")
        # One machine runs everything (tests, a laptop): its own folder will do, and goes with the process.
        base = tempfile.mkdtemp(prefix="ledgersift-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, max_rows: int) -> DataFrame:
    """Evaluate ``df`` once for several later uses: held as a small table if it fits, stored otherwise."""
    if max_rows <= BROADCAST_ROWS:
        table, small = bounded(df)
        if small:
            return table
    return stored(df, name)


# Up to this many rows a shuffle is cheap next to per-row model arithmetic.
SPREAD_ROWS = 10_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Give a small input, often one file split, to every core; larger inputs keep their splits."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if rows <= SPREAD_ROWS else df


def attach(df: DataFrame, table: DataFrame, on: str, max_rows: int = 50_000) -> DataFrame:
    """Join per-point results to rows; a checked small table is broadcast, so one point held by most rows costs no skew.

    Larger tables meet the rows in a shuffle, where adaptive execution splits an oversized partition.
    """
    return df.join(bounded(table, max_rows)[0], on)
