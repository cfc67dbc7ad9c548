"""Monetary-unit selection: probability proportional to value.

Values are whole minor units laid end to end in the given order; a total of T units
is cut into n intervals, equal to within one unit, and one unit is drawn in each. A row covering the units
(lo, hi] is selected when it covers a drawn unit. Which intervals a row touches is
arithmetic on lo and hi, and an interval lying wholly inside a row always hits it, so
two points per row decide membership (with fewer units than intervals every unit is
drawn, and the same test holds): no range join, no expansion of a row that
covers a million intervals. Buckets of the order that hold no drawn unit are never
ranked at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import bounded, require_columns, require_size, settled
from ..errors import ColumnError, EmptyPopulationError, NegativeValueError, SampleSizeError
from ..functions import hash_hex, hash_uint32, exact_minor_units, ordered_bucket, seed_draw, uniform
from ..functions.hashing import UINT32
from .order_statistics import hash_bucket, hash_buckets, kth_cut
from .random_sampling import mark_sample
from .ranking import RangeBuckets, rank_within_buckets
from .stratified import mus_allocation, stratum_counts

WHOLE = "__all"


def threshold_filter(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Rows whose value reaches the threshold."""
    return df.where(F.col(value) >= F.lit(threshold))


def interval_start(i: Column) -> Column:
    """Units before interval i: the first ``__rem`` intervals have ``__w`` + 1 units, the others ``__w``."""
    return i * F.col("__w") + F.least(i, F.col("__rem"))


def drawn_unit(i: Column, seed: int, stratum: Column) -> Column:
    """The monetary unit drawn in interval i."""
    width = F.col("__w") + (i < F.col("__rem")).cast("int")
    draw = hash_uint32(hash_hex(seed, "mus", stratum, i)) - 1
    offset = F.floor(draw / F.lit(float(UINT32)) * width)
    return interval_start(i) + 1 + F.least(offset, width - 1)


def interval_of(unit: Column) -> Column:
    """Index of the interval that contains a unit; 64-bit throughout."""
    wide_units = F.col("__rem") * (F.col("__w") + 1)
    in_wide = F.call_function("div", unit - 1, F.col("__w") + 1)
    in_narrow = F.col("__rem") + F.call_function("div", unit - 1 - wide_units, F.nullif(F.col("__w"), F.lit(0)))
    return F.when(unit <= wide_units, in_wide).otherwise(in_narrow)


def keep_hits(rows: DataFrame, low: Column, high: Column, seed: int, stratum: Column) -> DataFrame:
    """Rows whose units (low, high] include a drawn unit; needs ``__w`` and ``__rem`` of the stratum."""
    spans = (
        rows.where(high > low)
        .withColumn("__low", low)
        .withColumn("__high", high)
        .withColumn("__first", interval_of(F.col("__low") + 1))
        .withColumn("__last", interval_of(F.col("__high")))
        .withColumn("__p", drawn_unit(F.col("__first"), seed, stratum))
        .withColumn("__q", drawn_unit(F.col("__last"), seed, stratum))
    )
    # An interval met only at one end is hit from that end; one in between is covered whole.
    several = "__last > __first AND (__last - __first >= 2 OR __p > __low OR __q <= __high)"
    inside = f"({several}) OR (__last = __first AND __p > __low AND __p <= __high)"
    return spans.where(inside).drop("__low", "__high", "__first", "__last", "__p", "__q")


def race_time(value: Column, seed: int, *key: str) -> Column:
    """Exponential arrival with rate = value: ordering by it draws rows by value without replacement."""
    return -F.log(uniform(seed, "race", *key)) / value.cast("double")


def mus_sample(
    df: DataFrame,
    sample_size: int,
    value: str,
    key: Sequence[str],
    order_by: Sequence[str] | None = None,
    threshold: float | None = None,
    strata: Sequence[str] = (),
    seed: int | None = None,
    negatives: str = "error",
    scale: int = 2,
    with_topup: bool = True,
) -> DataFrame:
    """Flag ``sample_size`` rows with probability proportional to value, overall or per stratum.

    Strata no larger than their allocation are taken whole; strata worth nothing are
    drawn uniformly; rows hit more than once are replaced by an exponential race over
    the unselected rows of positive value. Fewer rows than asked are selected only when
    too few have a positive value.
    """
    require_size(sample_size)
    require_columns(df, value, *key, *strata, *(order_by or ()))
    seed = seed_draw() if seed is None else seed
    picked = mus_picked(df, sample_size, value, key, order_by, threshold, strata, seed, negatives, scale, with_topup)
    return mark_sample(df, picked, key, sample_size)


def mus_picked(
    df: DataFrame, sample_size: int, value: str, key: Sequence[str], order_by: Sequence[str] | None,
    threshold: float | None, strata: Sequence[str], seed: int, negatives: str, scale: int, with_topup: bool,
) -> DataFrame:
    """Keys of the selected rows."""
    order_by = list(order_by or key)
    kept = df if threshold is None else threshold_filter(df, value, threshold)
    amount = exact_minor_units(df, value, scale)
    if negatives == "abs":
        amount = F.abs(amount)
    elif negatives == "drop":
        kept = kept.where(amount >= 0)
    elif negatives != "error":
        raise ColumnError("negatives must be 'error', 'drop' or 'abs'")
    groups = list(strata)
    if not groups:
        groups = [WHOLE]
        kept = kept.withColumn(WHOLE, F.lit(""))
    rows = kept.na.drop(subset=groups).select(
        *dict.fromkeys([*groups, *order_by, *key]), F.coalesce(amount, F.lit(0).cast("long")).alias("__m")
    )
    texts = [F.col(g).cast("string") for g in groups]
    # Several values with their lengths in front: no two strata share a text, hence draws.
    stratum = texts[0] if len(texts) == 1 else F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])

    checks = kept.agg(F.count(F.lit(1)).alias("rows"), F.min(amount).alias("least")).first()
    if not checks["rows"]:
        raise EmptyPopulationError("no record remains after the threshold")
    if checks["least"] is not None and checks["least"] < 0:
        raise NegativeValueError(f"column {value} has negative values; choose negatives='drop' or 'abs'")

    buckets = RangeBuckets.plan(rows, order_by, key, checks["rows"])
    totals = buckets.totals(rows, F.col("__m"), groups)
    sizes = totals.groupBy(*groups).agg(
        F.sum("__rows").alias("stratum_size"), F.sum("__sum").alias("__total")
    )
    if strata:
        wanted = mus_allocation(sizes.select(*groups, "stratum_size"), groups, sample_size)
        plan = wanted.join(sizes.select(*groups, "__total"), groups).withColumnRenamed("allocated", "__n")
    else:
        plan = sizes.withColumn("__n", F.lit(sample_size).cast("long"))
    width = F.call_function("div", F.col("__total"), F.col("__n"))
    plan = (
        plan.where("__n > 0")
        .withColumn("__buckets", hash_buckets(F.col("stratum_size")))
        .withColumn("__w", width)
        .withColumn("__rem", F.col("__total") % F.col("__n"))
    )
    plan = bounded(plan)[0]

    whole = plan.where("stratum_size <= __n").select(*groups)
    worthless = plan.where("stratum_size > __n AND __total = 0")
    valued = plan.where("stratum_size > __n AND __total > 0").select(*groups, "__n", "__w", "__rem")

    picked = rows.join(whole, groups, "left_semi").select(*key)

    below, upto = F.col("__below"), F.col("__below") + F.col("__sum")
    hit_buckets = keep_hits(totals.join(valued, groups), below, upto, seed, stratum)
    ranked = rank_within_buckets(buckets, rows.withColumn("__units", F.col("__m")), hit_buckets, F.col("__m"), groups)
    upto = F.col("running_total")
    hits = keep_hits(ranked.join(valued, groups), upto - F.col("__units"), upto, seed, stratum)
    hits = settled(hits.select(*groups, *[k for k in key if k not in groups]), "mus-hits", sample_size)
    picked = picked.unionByName(hits.select(*key))

    free = kth_free(rows, worthless, groups, key, seed)
    if free is not None:
        picked = picked.unionByName(free)
    if with_topup:
        more = topup(rows, hits, valued, groups, key, seed)
        if more is not None:
            picked = picked.unionByName(more)
    return picked


def kth_free(rows, worthless, groups, key, seed) -> DataFrame | None:
    """Uniform draw inside strata whose total is zero."""
    if worthless.limit(1).count() == 0:
        return None
    h = hash_hex(seed, "srs", *key)
    order = [h.alias("__h"), *[F.col(k) for k in key]]
    members = rows.join(worthless, groups)
    cuts = kth_cut(members, groups, F.col("__n"), hash_bucket(h, F.col("__buckets")), order)
    return _below_cut(members, cuts, groups, order, key)


def topup(rows, hits, valued, groups, key, seed) -> DataFrame | None:
    """Winners of the exponential race among unselected rows of positive value."""
    got = hits.groupBy(*groups).agg(F.count(F.lit(1)).alias("__got"))
    short = valued.join(got, groups, "left").withColumn("__need", F.col("__n") - F.coalesce("__got", F.lit(0)))
    short = bounded(short.where("__need > 0").select(*groups, "__need"))[0]
    if short.limit(1).count() == 0:
        return None
    left = rows.where("__m > 0").join(short, groups).join(hits.select(*key), list(key), "left_anti")
    time = race_time(F.col("__m"), seed, *key)
    order = [time.alias("__t"), *[F.col(k) for k in key]]
    cuts = kth_cut(left, groups, F.col("__need"), ordered_bucket(time), order)
    return _below_cut(left, cuts, groups, order, key)


def _below_cut(rows, cuts, groups, order, key) -> DataFrame:
    cuts = bounded(cuts)[0]
    return rows.join(cuts, groups).where(F.struct(*order) <= F.col("cut")).select(*key)


def mus_shortfall(flagged: DataFrame, sample_size: int) -> int:
    """How many rows fewer than asked were selected."""
    chosen = flagged.agg(F.sum("is_sample")).first()[0] or 0
    if chosen > sample_size:
        raise SampleSizeError("selection exceeds the sample size")
    return sample_size - int(chosen)
