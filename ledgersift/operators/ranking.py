"""Row identity, global rank and running totals without a single-partition window.

The population is cut into buckets along the full order tuple (order columns, then
key). Tuples are unique, so even one order value held by a third of all rows spreads
over many buckets. Totals per bucket give each bucket its starting rank and running
total; windows then run inside buckets only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import bounded, require_columns
from ..errors import ColumnError

MAX_BUCKETS = 16_384
ROWS_PER_BUCKET = 500_000
MIN_BUCKETS = 8
OVERSAMPLE = 30


def _comparable(df: DataFrame, name: str) -> Column:
    """Order-preserving form of a column whose values are safe as plan literals."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name))
    if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType)):
        return F.col(name)
    raise ColumnError(f"cannot order by column {name} of type {kind.simpleString()}")


def _json(value) -> str:
    return format(value, "f") if isinstance(value, Decimal) else json.dumps(value)


@dataclass(frozen=True)
class RangeBuckets:
    """Cuts of the order tuple, held as literals: a row's bucket is a pure expression."""

    order_by: tuple[str, ...]
    key: tuple[str, ...]
    types: tuple[T.DataType, ...]
    cuts: tuple[tuple, ...]

    @classmethod
    def plan(
        cls, df: DataFrame, order_by: Sequence[str], key: Sequence[str], rows: int, buckets: int | None = None
    ) -> RangeBuckets:
        require_columns(df, *order_by, *key)
        columns = tuple(dict.fromkeys([*order_by, *key]))
        shaped = df.select(*[_comparable(df, c).alias(c) for c in columns])
        if buckets is None:
            buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-rows // ROWS_PER_BUCKET)))
        wanted = buckets * OVERSAMPLE
        # The cuts are collected once, so an unseeded difference between runs moves no result.
        drawn = shaped if rows <= wanted else shaped.sample(wanted / rows, seed=7)
        cuts = [tuple(r) for r in drawn.orderBy(*columns).collect()]  # about `wanted` tuples
        step = max(1, len(cuts) // buckets)
        kept = cuts[step - 1 : step * buckets : step][: buckets - 1]
        return cls(columns, tuple(key), tuple(f.dataType for f in shaped.schema), tuple(kept))

    def column(self, df: DataFrame) -> Column:
        """Number of cuts below the row: a binary search over a literal array."""
        if not self.cuts:
            return F.lit(0)
        row = F.struct(*[_comparable(df, c).alias(f"f{i}") for i, c in enumerate(self.order_by)])
        # One JSON literal, folded by the optimizer into an array; thousands of separate literals plan slowly.
        lines = (",".join(f'"f{i}":{_json(v)}' for i, v in enumerate(cut)) for cut in self.cuts)
        fields = ",".join(f"f{i}: {t.simpleString()}" for i, t in enumerate(self.types))
        cuts = F.from_json(F.lit("[" + ",".join("{" + line + "}" for line in lines) + "]"), f"array<struct<{fields}>>")
        power = 1 << (len(self.cuts).bit_length() - 1)
        steps = []
        while power:
            steps.append(F.lit(power))
            power >>= 1
        return F.aggregate(
            F.array(*steps),
            F.lit(0),
            lambda low, s: F.when(F.get(cuts, low + s - 1) < row, low + s).otherwise(low),
        )

    def totals(self, df: DataFrame, value: Column | None = None, strata: Sequence[str] = ()) -> DataFrame:
        """``strata..., __bucket, __rows, __sum, __before, __below``: size of each bucket and what precedes it."""
        strata = list(strata)
        amount = (F.lit(0) if value is None else value).cast("long")
        table = (
            df.select(*strata, self.column(df).alias("__bucket"), amount.alias("__v"))
            .groupBy(*strata, "__bucket")
            .agg(F.count(F.lit(1)).alias("__rows"), F.sum("__v").alias("__sum"))
        )
        if not strata:
            table = table.withColumn("__g", F.lit(0))
        earlier = Window.partitionBy(*(strata or ["__g"])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        table = table.select(
            *strata, "__bucket", "__rows", "__sum",
            F.coalesce(F.sum("__rows").over(earlier), zero).alias("__before"),
            F.coalesce(F.sum("__sum").over(earlier), zero).alias("__below"),
        )
        return bounded(table)[0]


def rank_within_buckets(
    buckets: RangeBuckets,
    df: DataFrame,
    totals: DataFrame,
    value: Column | None = None,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Rows of the buckets in ``totals`` with ``position`` (0-based) and, given a value, ``running_total``."""
    strata = list(strata)
    ordered = Window.partitionBy(*strata, "__bucket").orderBy(*buckets.order_by)
    totals = bounded(totals.select(*strata, "__bucket", "__before", "__below"))[0]
    rows = df.withColumn("__bucket", buckets.column(df))
    if value is not None:
        rows = rows.withColumn("__v", value)
    rows = rows.join(totals, [*strata, "__bucket"])
    rows = rows.withColumn("position", F.col("__before") + F.row_number().over(ordered) - 1)
    if value is not None:
        upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("running_total", F.col("__below") + F.sum(F.col("__v").cast("long")).over(upto)).drop("__v")
    return rows.drop("__bucket", "__before", "__below")


def global_rank(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str], strata: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Add ``position``: 0-based place in the total order (order_by, key), overall or within strata."""
    buckets = RangeBuckets.plan(df, order_by, key, df.count() if rows is None else rows)
    return rank_within_buckets(buckets, df, buckets.totals(df, strata=strata), strata=strata)


def prefix_sum(
    df: DataFrame, value: Column, order_by: Sequence[str], key: Sequence[str],
    strata: Sequence[str] = (), rows: int | None = None,
) -> DataFrame:
    """Add ``position`` and ``running_total`` of a whole-number value along the order."""
    buckets = RangeBuckets.plan(df, order_by, key, df.count() if rows is None else rows)
    return rank_within_buckets(buckets, df, buckets.totals(df, value, strata), value, strata)


def with_row_key(df: DataFrame, name: str = "row_key", copies_per_task: int = 1_000_000) -> DataFrame:
    """Add a stable unique key to rows that have none: content hash and copy number.

    Equal rows are interchangeable, so they are collapsed to a count (combined before
    the shuffle) and expanded again: a row repeated a billion times is one group entry,
    and its expansion is spread over tasks.
    """
    columns = df.columns
    # Every value with its length in front, nulls as a mark of their own: no two rows share a text.
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("null;")) for v in values])
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__m"))
    counted = counted.withColumn("__h", F.sha2(text, 256))

    def numbered(rows: DataFrame) -> DataFrame:
        first = F.col("__block") * copies_per_task + 1
        last = F.least(F.col("__m"), first + copies_per_task - 1)
        return rows.withColumn("__i", F.explode(F.sequence(first, last)))

    few = numbered(counted.where(F.col("__m") <= copies_per_task).withColumn("__block", F.lit(0).cast("long")))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m") - 1) / copies_per_task))
    many = counted.where(F.col("__m") > copies_per_task).withColumn("__block", F.explode(blocks))
    many = numbered(many.repartition("__h", "__block"))
    key = F.concat_ws("-", "__h", F.col("__i").cast("string"))
    return few.unionByName(many).select(key.alias(name), *columns)


def check_unique_key(df: DataFrame, key: Sequence[str]) -> bool:
    """True when no key value repeats; partial counts are combined before the shuffle."""
    return df.groupBy(*key).count().where("count > 1").limit(1).count() == 0


def require_unique_key(df: DataFrame, key: Sequence[str]) -> None:
    if not check_unique_key(df, key):
        raise ColumnError(f"key {list(key)} is not unique; with_row_key builds one that is")
