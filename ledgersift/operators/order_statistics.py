"""Cut points of ordered selections, without sorting the population.

"The k smallest rows" is answered in two passes. The first counts rows per coarse
bucket of the ordering (a small, map-side combined aggregate) and finds the bucket
that holds the k-th row; the second ranks only the rows of that bucket, which is
narrowed further by counting between drawn cuts until a task can hold it. The result
is one cut per group, and ``row <= cut`` then flags the population with no join on
keys and no task that holds a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import bounded, require_columns, require_size
from ..errors import SampleSizeError
from ..functions import hash_hex, hash_uint32, ordered_bucket
from ..functions.hashing import UINT32

ROWS_PER_BUCKET = 65_536
PRUNED_ROWS = 100_000
EDGE_ROWS = 100_000  # rows of a group that one task may rank; a larger part is narrowed by counting first
CUTS = 1_000
LAST_BUCKET = 1 << 40


def hash_buckets(rows: Column) -> Column:
    """Number of hash buckets (1..65536, a power of two) that leaves about 65k rows in each."""
    need = F.ceil(rows / F.lit(ROWS_PER_BUCKET))
    return F.least(F.lit(65_536), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(need, F.lit(1)))))).cast("long")


def hash_bucket(hex_hash: Column, buckets: Column) -> Column:
    return F.floor((hash_uint32(hex_hash) - 1) / (F.lit(UINT32) / buckets)).cast("long")


def kth_cut(
    df: DataFrame, groups: Sequence[str], k: Column, bucket: Column, order: Sequence[Column]
) -> DataFrame:
    """One row per group: ``groups..., cut`` where ``struct(order)`` of the k-th row is ``cut``.

    ``bucket`` must not decrease along ``order``; ``k`` is constant within a group.
    Groups with k < 1 are absent; if k exceeds the group the cut is its last row.
    """
    groups = list(groups)
    keyed = df.select(*groups, k.alias("__k"), bucket.alias("__b"), F.struct(*order).alias("cut")).where("__k >= 1")
    if not groups:
        keyed = keyed.withColumn("__g", F.lit(0))
    by = groups or ["__g"]
    counts = keyed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"), F.max("__k").alias("__k"))
    running = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    edges = _edge(counts.withColumn("__nth", F.least("__k", F.sum("__c").over(Window.partitionBy(*by)))), by, ["__b"])
    edges, _ = bounded(edges.select(*by, "__b", "__nth", "__c"))
    pool = keyed.drop("__k").join(edges, [*by, "__b"]).drop("__b")
    while (edges.agg(F.max("__c")).first()[0] or 0) > EDGE_ROWS:
        edges, settled = _narrowed(pool, by)
        low_high = edges.select(*by, "__nth", "__c", F.col("__lo"), F.col("__hi"))
        pool = keyed.select(*by, "cut").join(low_high, by).where("cut >= __lo AND cut <= __hi").drop("__lo", "__hi")
        if settled:  # what is left in every large group is one repeated tuple
            break
    # Equal tuples are one row with a count, so at most EDGE_ROWS rows of a group are ranked in a task.
    distinct = pool.groupBy(*by, "cut").agg(F.count(F.lit(1)).alias("__n"), F.max("__nth").alias("__nth"))
    within = Window.partitionBy(*by).orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.withColumn("__upto", F.sum("__n").over(within))
        .where("__nth <= __upto AND __nth > __upto - __n")
        .select(*groups, "cut")
    )


def _edge(counts: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with a count ``__c``, the one per group that holds the ``__nth``; its ``__nth`` becomes local."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = counts.withColumn("__upto", F.sum("__c").over(running)).where("__nth <= __upto AND __nth > __upto - __c")
    return held.withColumn("__nth", F.col("__nth") - F.col("__upto") + F.col("__c")).drop("__upto")


def _narrowed(pool: DataFrame, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """Bounds of a part of each group's pool that still holds its ``__nth``: about ``CUTS`` times fewer rows.

    Cuts are a random draw of order tuples; the part is bounded by tuples that were counted, so the draw decides
    how far the pool shrinks, never the result.
    """
    drawn = pool.where(F.rand(7) < F.lit(float(CUTS)) / F.col("__c")).groupBy(*by).agg(
        F.array_sort(F.collect_list("cut")).alias("__cuts")  # about CUTS tuples
    )
    steps = F.array(*[F.lit(1 << e) for e in range(CUTS.bit_length() + 1, -1, -1)])
    place = F.aggregate(
        steps, F.lit(0), lambda low, s: F.when(F.get("__cuts", low + s - 1) < F.col("cut"), low + s).otherwise(low)
    )
    placed = pool.join(drawn, by, "left").withColumn("__p", F.when(F.col("__cuts").isNull(), 0).otherwise(place))
    counts = placed.groupBy(*by, "__p").agg(
        F.count(F.lit(1)).alias("__c"), F.max("__nth").alias("__nth"), F.min("cut").alias("__lo"), F.max("cut").alias("__hi")
    )
    edges, _ = bounded(_edge(counts, by, ["__p"]))
    open_groups = edges.where(F.col("__c") > EDGE_ROWS).where("__lo <> __hi")
    return edges, open_groups.limit(1).count() == 0


def flag_up_to_cut(df: DataFrame, groups: Sequence[str], cuts: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``is_sample``: 1 for rows whose order tuple is not above their group's cut."""
    position = F.struct(*order)
    if not groups:
        found = cuts.collect()  # one row
        if not found:
            return df.withColumn("is_sample", F.lit(0))
        literal = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                             for v, f in zip(found[0]["cut"], cuts.schema["cut"].dataType.fields)])
        return df.withColumn("is_sample", (position <= literal).cast("int"))
    cuts, _ = bounded(cuts)
    names = [f"__g{i}" for i in range(len(groups))]
    cuts = cuts.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("cut").alias("__cut"))
    on = [df[g] == cuts[n] for g, n in zip(groups, names)]
    return (
        df.join(cuts, on, "left")
        .withColumn("is_sample", F.coalesce((position <= F.col("__cut")).cast("int"), F.lit(0)))
        .drop(*names, "__cut")
    )


def top_n_by_score(
    df: DataFrame, score: str, n: int, key: Sequence[str], highest: bool = False, groups: Sequence[str] = ()
) -> DataFrame:
    """Flag the n lowest (or highest) scores, overall or per group; ties by key, null and NaN scores last."""
    require_size(n)
    require_columns(df, score, *key, *groups)
    value = F.col(score)
    missing = value.isNull() | F.isnan(value) if df.schema[score].dataType.typeName() in ("double", "float") else value.isNull()
    signed = F.when(~missing, -value if highest else value)
    # Rows without a score come last in either direction.
    order = [missing.cast("int").alias("__missing"), signed.alias("__s"), *[F.col(k) for k in key]]
    bucket = F.when(missing, F.lit(LAST_BUCKET)).otherwise(ordered_bucket(signed))
    cuts = kth_cut(df, groups, F.lit(n).cast("long"), bucket, order)
    return flag_up_to_cut(df, groups, cuts, order)


def smallest_hashes(
    df: DataFrame, n: int, key: Sequence[str], seed: int, tag: str = "srs", rows: int | None = None,
    among: Column | None = None,
) -> DataFrame:
    """Flag exactly n rows chosen uniformly: those with the smallest key hashes.

    ``among`` restricts the choice to rows that meet a condition; ``rows`` is their number.
    """
    require_size(n)
    require_columns(df, *key)
    pool = df if among is None else df.where(among)
    rows = pool.count() if rows is None else rows
    if n > rows:
        raise SampleSizeError(f"sample size {n} exceeds population size {rows}")
    h = hash_hex(seed, tag, *key)
    order = [h.alias("__h"), *[F.col(k) for k in key]]
    cuts = _pruned_cut(pool, n, rows, h, order)
    if cuts is None:
        cuts = kth_cut(pool, [], F.lit(n).cast("long"), hash_bucket(h, hash_buckets(F.lit(rows))), order)
    flagged = flag_up_to_cut(df, [], cuts, order)
    if among is None:
        return flagged
    return flagged.withColumn("is_sample", F.when(among, F.col("is_sample")).otherwise(0))


def _pruned_cut(df: DataFrame, n: int, rows: int, h: Column, order: Sequence[Column]) -> DataFrame | None:
    """The n-th smallest hash among rows below a draw that leaves about n + 6 sqrt(n); None if too few remain."""
    if n > PRUNED_ROWS:
        return None
    share = min(1.0, (n + 6 * math.sqrt(n) + 10) / rows)
    low = df.where(hash_uint32(h) <= F.lit(int(share * UINT32)))
    table = low.select(F.struct(*order).alias("cut")).orderBy("cut").offset(n - 1).limit(1).toArrow()
    if not table.num_rows:
        return None
    return df.sparkSession.createDataFrame(table)
