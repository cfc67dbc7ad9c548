"""Tables that describe and justify a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import bounded
from ..functions import exact_minor_units
from .monetary import threshold_filter
from .ranking import prefix_sum
from .stratified import population_of, stratum_counts


def population_totals(df: DataFrame, value: str, scale: int = 2) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("population_size"), F.sum(exact_minor_units(df, value, scale)).alias("total_minor"))


def stratum_shares(df: DataFrame, stratum: str) -> DataFrame:
    """``stratum, stratum_size, percent`` of the non-null strata."""
    counts = bounded(stratum_counts(df, [stratum]))[0]
    total = population_of(counts)
    return counts.withColumn("percent", F.col("stratum_size") * F.lit(100.0) / F.lit(total))


def strata_comparison(
    flagged: DataFrame, stratum: str, threshold: float | None = None, value: str | None = None
) -> DataFrame:
    """Share of every stratum in the population (after the threshold) and in the sample."""
    sampled = F.col("is_sample") == 1
    reached = F.lit(True) if threshold is None else F.coalesce(F.col(value) >= threshold, F.lit(False))
    counts = (
        flagged.na.drop(subset=[stratum])
        .groupBy(stratum)
        .agg(F.count_if(reached).alias("population_size"), F.count_if(sampled).alias("sample_size"))
    )
    counts = bounded(counts)[0]
    totals = counts.agg(F.sum("population_size").alias("p"), F.sum("sample_size").alias("s")).first()
    return counts.where("population_size > 0").select(
        F.col(stratum).alias("stratum"),
        (F.col("population_size") * F.lit(100.0) / F.lit(totals["p"] or 1)).alias("population_percent"),
        (F.col("sample_size") * F.lit(100.0) / F.lit(totals["s"] or 1)).alias("sample_percent"),
    )


def cumulative_curve(
    flagged: DataFrame, value: str, key: Sequence[str], strata: Sequence[str] = (),
    threshold: float | None = None, scale: int = 2, max_points: int | None = None,
) -> DataFrame:
    """Running total along ascending value: ``(strata), position, running_total, is_sample``.

    ``max_points`` thins unselected points evenly for plotting; selected points stay.
    """
    rows = flagged if threshold is None else threshold_filter(flagged, value, threshold)
    rows = rows.na.drop(subset=[value, *strata])
    amount = exact_minor_units(flagged, value, scale)
    narrow = rows.select(*dict.fromkeys([*strata, *key]), F.col(value), F.col("is_sample"))
    count = narrow.count()
    curve = prefix_sum(narrow, amount, [value], key, strata, rows=count)
    if max_points is not None and count > max_points:
        step = -(-count // max_points)
        curve = curve.where((F.col("is_sample") == 1) | (F.col("position") % step == 0))
    return curve.select(*dict.fromkeys([*strata, *key]), "position", "running_total", "is_sample")


def method_summary(
    flagged: DataFrame, method: str, sample_size: int, seed: int, value: str | None = None,
    threshold: float | None = None, strata: str | None = None, created: str | None = None, scale: int = 2,
) -> DataFrame:
    """One row describing how the sample was drawn; ``created`` is passed in, not read from a clock."""
    money = F.sum(exact_minor_units(flagged, value, scale)) if value else F.lit(None).cast("long")
    kept = F.count_if(F.col(value) >= threshold) if value and threshold is not None else F.count(F.lit(1))
    return flagged.agg(
        F.lit(method).alias("method"),
        F.count(F.lit(1)).alias("population_size"),
        F.lit(sample_size).cast("int").alias("sample_size"),
        F.sum("is_sample").cast("long").alias("selected"),
        money.alias("total_minor"),
        F.lit(threshold).cast("double").alias("threshold"),
        kept.alias("filtered_size"),
        F.lit(strata).cast("string").alias("strata"),
        F.lit(seed).cast("int").alias("seed"),
        F.lit(created).cast("string").alias("created"),
    )


def trial_table(spark: SparkSession, trials: Sequence[tuple[int, dict[str, float], float | None]]) -> DataFrame:
    schema = T.StructType([
        T.StructField("trial", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("value", T.DoubleType()),
    ])
    return spark.createDataFrame([(n, p, v) for n, p, v in trials], schema)


def trial_history(trials: DataFrame) -> DataFrame:
    """Completed trials and their values."""
    return trials.where("value IS NOT NULL").select("trial", "value")


def trials_long(trials: DataFrame) -> DataFrame:
    """One row per (trial, param, value)."""
    return trials.where("value IS NOT NULL").select("trial", F.explode("params").alias("param", "setting"), "value")


def param_effect(long: DataFrame, bins: int = 10) -> DataFrame:
    """Share of the variance of the objective explained by each parameter (eta squared over equal-width bins)."""
    spans = long.groupBy("param").agg(
        F.min("setting").alias("low"), F.max("setting").alias("high"),
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.count(F.lit(1)).alias("n"),
    )
    place = F.coalesce(F.try_divide((F.col("setting") - F.col("low")) * bins, F.col("high") - F.col("low")), F.lit(0.0))
    slot = F.least(F.floor(place), F.lit(bins - 1))
    binned = long.join(bounded(spans)[0], "param").groupBy("param", "mean", "variance", "n", slot.alias("slot"))
    means = binned.agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("c"))
    between = F.sum(F.col("c") * F.pow(F.col("m") - F.col("mean"), 2)) / F.first("n")
    effect = F.coalesce(F.try_divide(between, F.first("variance")), F.lit(0.0))
    return means.groupBy("param").agg(effect.alias("effect"))


def sampling_report(spark: SparkSession, sections: dict[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """``section, item, value`` rows: preparation, method and summary lines of one run."""
    rows = [(s, str(i), None if v is None else str(v)) for s, lines in sections.items() for i, v in lines]
    return spark.createDataFrame(rows, "section string, item string, value string")
