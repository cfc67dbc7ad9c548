"""Stratified selection and the two allocation rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import bounded, require_columns, require_size
from ..errors import EmptyPopulationError, SampleSizeError
from ..functions import half_even_share, hash_hex, seed_draw
from ..functions.numeric import exact_div, wide_product
from .order_statistics import flag_up_to_cut, hash_bucket, hash_buckets, kth_cut
from .ranking import global_rank


def stratum_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """``strata..., stratum_size``; rows with a null stratum are left out."""
    return df.na.drop(subset=list(strata)).groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))


def _ranked(
    shares: DataFrame, total: str, order: Sequence[str], strata: Sequence[str], small: bool
) -> DataFrame:
    """Add 0-based ``position`` and ``__sum`` of the ``total`` column to a stratum table.

    A table known to be small uses one window; otherwise range buckets are used.
    """
    if small:
        whole = Window.partitionBy("__g")
        return (
            shares.withColumn("__g", F.lit(0))
            .withColumn("position", (F.row_number().over(whole.orderBy(*order, *strata)) - 1).cast("long"))
            .withColumn("__sum", F.sum(total).over(whole))
        )
    row = shares.agg(F.sum(total).alias("sum"), F.count(F.lit(1)).alias("rows")).first()
    return global_rank(shares, order, strata, rows=row["rows"]).withColumn("__sum", F.lit(row["sum"]))


def population_of(counts: DataFrame) -> int:
    rows = counts.agg(F.sum("stratum_size")).first()[0]
    if not rows:
        raise EmptyPopulationError("no row has a stratum")
    return int(rows)


def stratified_allocation(counts: DataFrame, strata: Sequence[str], sample_size: int) -> DataFrame:
    """Largest-remainder shares in whole numbers: ``strata..., stratum_size, allocated``.

    Remainder ties go to the larger stratum, then to the smaller stratum value.
    """
    require_size(sample_size)
    counts, small = bounded(counts)
    total = F.lit(population_of(counts)).cast("decimal(19,0)")
    product = wide_product(F.col("stratum_size"), F.lit(sample_size))
    shares = counts.select(
        *strata, "stratum_size",
        exact_div(product, total).alias("__base"),
        (-(product % total)).cast("decimal(38,0)").alias("__rem"),
        (-F.col("stratum_size")).alias("__size"),
    )
    ranked = _ranked(shares, "__base", ["__rem", "__size"], strata, small)
    extra = (F.col("position") < F.lit(sample_size) - F.col("__sum")).cast("int")
    return ranked.select(*strata, "stratum_size", (F.col("__base") + extra).alias("allocated"))


def mus_allocation(counts: DataFrame, strata: Sequence[str], sample_size: int) -> DataFrame:
    """Half-even rounded shares, corrected by one on the largest allocations.

    Each of the |difference| largest allocations changes by at most one and zeros are
    skipped, so the total can stay off target when there are few strata.
    """
    require_size(sample_size)
    counts, small = bounded(counts)
    share = half_even_share(F.col("stratum_size"), F.lit(population_of(counts)), F.lit(sample_size))
    shares = counts.select(*strata, "stratum_size", share.alias("__share"), (-share).alias("__big"))
    ranked = _ranked(shares, "__share", ["__big"], strata, small)
    off = F.lit(sample_size) - F.col("__sum")
    touched = (F.col("position") < F.abs(off)) & (F.col("__share") > 0)
    change = F.when(touched, F.signum(off)).otherwise(0).cast("long")
    return ranked.select(*strata, "stratum_size", (F.col("__share") + change).alias("allocated"))


def stratified_sample(
    df: DataFrame,
    sample_size: int,
    strata: Sequence[str],
    key: Sequence[str],
    seed: int | None = None,
    null_stratum: str = "exclude",
) -> DataFrame:
    """Simple random selection of the allocated number inside every stratum; flagged in ``is_sample``.

    ``null_stratum='group'`` treats null as a stratum of its own; 'exclude' leaves such
    rows out of counts and sample.
    """
    require_size(sample_size)
    require_columns(df, *strata, *key)
    seed = seed_draw() if seed is None else seed
    groups = list(strata)
    if null_stratum == "group":
        groups = [f"__stratum{i}" for i in range(len(strata))]
        for g, s in zip(groups, strata):
            df = df.withColumn(g, F.coalesce(F.concat(F.lit("v"), F.col(s).cast("string")), F.lit("null")))
    counts = bounded(stratum_counts(df, groups))[0]
    population = population_of(counts)
    if sample_size > population:
        raise SampleSizeError(f"sample size {sample_size} exceeds population size {population}")
    allocation = bounded(
        stratified_allocation(counts, groups, sample_size)
        .select(*groups, "allocated", hash_buckets(F.col("stratum_size")).alias("__buckets"))
    )[0]
    h = hash_hex(seed, "srs", *key)
    order = [h.alias("__h"), *[F.col(k) for k in key]]
    narrow = df.select(*dict.fromkeys([*groups, *key])).join(allocation, groups)
    cuts = kth_cut(narrow, groups, F.col("allocated"), hash_bucket(h, F.col("__buckets")), order)
    flagged = flag_up_to_cut(df, groups, cuts, order)
    return flagged.drop(*groups) if null_stratum == "group" else flagged
