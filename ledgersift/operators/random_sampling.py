"""Simple random and systematic selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import BROADCAST_ROWS, require_columns, require_size
from ..errors import SampleSizeError
from ..functions import seed_draw, uniform
from .order_statistics import smallest_hashes
from .ranking import RangeBuckets, rank_within_buckets, require_unique_key


def random_sample(df: DataFrame, sample_size: int, key: Sequence[str], seed: int | None = None) -> DataFrame:
    """Exactly ``sample_size`` rows, each subset equally likely; flagged in ``is_sample``."""
    return smallest_hashes(df, sample_size, key, seed_draw() if seed is None else seed)


def fraction_subsample(
    df: DataFrame, fraction: float, key: Sequence[str], seed: int, mode: str = "exact"
) -> DataFrame:
    """A uniform fraction of the rows: exactly round(fraction * N), or by independent draws."""
    if not 0 < fraction <= 1:
        raise SampleSizeError("fraction must lie in (0, 1]")
    if fraction == 1:
        return df
    if mode == "bernoulli":
        return df.where(uniform(seed, "fraction", *key) <= fraction)
    rows = df.count()
    n = round(fraction * rows)
    if n == 0:
        return df.limit(0)
    return smallest_hashes(df, n, key, seed, "fraction", rows).where("is_sample = 1").drop("is_sample")


def systematic_start(seed: int, interval: int, spark) -> int:
    draw = spark.range(1).select(uniform(seed, "start", F.lit("0")).alias("u")).first()["u"]
    return min(int(draw * interval), interval - 1)


def systematic_step(df: DataFrame, sample_size: int, seed: int) -> tuple[int, int]:
    """(interval, start) of a systematic sample with whole intervals."""
    step = df.count() // sample_size
    return step, systematic_start(seed, step, df.sparkSession)


def systematic_sample(
    df: DataFrame,
    sample_size: int,
    order_by: Sequence[str],
    key: Sequence[str],
    seed: int | None = None,
    interval: str = "integer",
) -> DataFrame:
    """Every ``N // n``-th row of the given order from a random start; flagged in ``is_sample``.

    Only buckets that contain a selected position are ranked. ``interval='fractional'``
    spreads the positions over the whole population (start + floor(i * N / n)), which the
    integer interval does not when N is not a multiple of n.
    """
    require_size(sample_size)
    require_columns(df, *order_by, *key)
    seed = seed_draw() if seed is None else seed
    rows = df.count()
    if sample_size > rows:
        raise SampleSizeError(f"sample size {sample_size} exceeds population size {rows}")
    step = rows // sample_size
    start = systematic_start(seed, step, df.sparkSession)

    if interval == "integer":

        def chosen(position):
            i = F.floor((position - start) / step)
            return (position >= start) & ((position - start) % step == 0) & (i < sample_size)

        def first_at_or_after(position):
            i = F.greatest(F.ceil((position - start) / F.lit(step)), F.lit(0)).cast("long")
            return F.when(i < sample_size, start + i * step)

    elif interval == "fractional":

        def point(i):
            # floor(i * rows / n) in parts that stay within 64 bits
            part = F.call_function("div", i * F.lit(rows % sample_size), F.lit(sample_size))
            return i * F.lit(rows // sample_size) + part + start

        def first_at_or_after(position):
            guess = F.floor((position - start) * F.lit(sample_size / rows))
            hit = F.lit(None).cast("long")
            for shift in (2, 1, 0, -1):
                i = F.greatest(guess + shift, F.lit(0)).cast("long")
                hit = F.when((point(i) >= position) & (i < sample_size), point(i)).otherwise(hit)
            return hit

        def chosen(position):
            return first_at_or_after(position) == position

    else:
        raise SampleSizeError("interval must be 'integer' or 'fractional'")

    buckets = RangeBuckets.plan(df, order_by, key, rows)
    totals = buckets.totals(df)
    hit = totals.where(first_at_or_after(F.col("__before")) < F.col("__before") + F.col("__rows"))
    picked = (
        rank_within_buckets(buckets, df.select(*dict.fromkeys([*order_by, *key])), hit)
        .where(chosen(F.col("position")))
        .select(*key)
    )
    return mark_sample(df, picked, key, sample_size)


def mark_sample(df: DataFrame, picked: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """Add ``is_sample`` = 1 where the key is among the picked keys.

    ``size`` is the proven bound on the picked rows; it decides whether they are broadcast. A key that occurs
    twice would select rows nobody picked, so it is refused.
    """
    require_unique_key(df, key)
    picked = picked.select(*key).withColumn("__hit", F.lit(1))
    if size <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    else:
        picked = picked.hint("merge")
    return df.join(picked, list(key), "left").withColumn("is_sample", F.coalesce("__hit", F.lit(0))).drop("__hit")
