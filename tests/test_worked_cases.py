"""Cases small enough to work by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ledgersift.errors import (
    ColumnError, EmptyPopulationError, NegativeValueError, NoAnomaliesError, RowLimitError, SampleSizeError,
)
from ledgersift.operators.clustering import cluster_quota, quota_sample, relative_distance
from ledgersift.operators.density import noise_sample
from ledgersift.operators.features import (
    distinct_levels, fit_features, log1p_positive, one_hot, resolve_features, skewness,
)
from ledgersift.operators.monetary import mus_sample, mus_shortfall
from ledgersift.operators.quality import silhouette_sizes
from ledgersift.operators.random_sampling import random_sample, systematic_sample
from ledgersift.operators.ranking import check_unique_key, with_row_key
from ledgersift.operators.stratified import (
    mus_allocation, stratified_allocation, stratified_sample, stratum_counts,
)
from ledgersift.operators.summaries import cumulative_curve, strata_comparison
from ledgersift.plans import run_method


def numbers(spark, values):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, v double")


def chosen(df, key="id"):
    return sorted(r[key] for r in df.where("is_sample = 1").collect())


def counts(spark, **sizes):
    return spark.createDataFrame(list(sizes.items()), "g string, stratum_size bigint")


def allocated(df):
    return {r["g"]: r["allocated"] for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_systematic_positions(spark, seed):
    got = chosen(systematic_sample(spark.range(10), 3, ["id"], ["id"], seed))
    assert got[0] in (0, 1, 2)
    assert got == [got[0], got[0] + 3, got[0] + 6]


def test_systematic_integer_interval_never_reaches_the_tail(spark):
    assert chosen(systematic_sample(spark.range(199), 100, ["id"], ["id"], 1)) == list(range(100))


def test_systematic_fractional_interval_reaches_the_tail(spark):
    got = chosen(systematic_sample(spark.range(199), 100, ["id"], ["id"], 1, "fractional"))
    assert len(got) == 100 and got == [i * 199 // 100 + got[0] for i in range(100)]


@pytest.mark.parametrize("select", [
    lambda df: random_sample(df, 4, ["id"], 1), lambda df: systematic_sample(df, 4, ["id"], ["id"], 1),
])
def test_sample_larger_than_population(spark, select):
    with pytest.raises(SampleSizeError):
        select(spark.range(3))


def test_largest_remainder(spark):
    got = allocated(stratified_allocation(counts(spark, A=50, B=30, C=20), ["g"], 7))
    assert got == {"A": 4, "B": 2, "C": 1}
    assert allocated(stratified_allocation(counts(spark, A=1, B=1, C=1), ["g"], 2)) == {"A": 1, "B": 1, "C": 0}


def test_half_even_allocation(spark):
    assert allocated(mus_allocation(counts(spark, A=50, B=30, C=20), ["g"], 7)) == {"A": 4, "B": 2, "C": 1}
    assert allocated(mus_allocation(counts(spark, A=1, B=1, C=1), ["g"], 2)) == {"A": 0, "B": 1, "C": 1}


def test_null_strata(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "x") for i in range(20)], "id bigint, g string")
    assert [r["stratum_size"] for r in stratum_counts(df, ["g"]).collect()] == [15]
    assert min(chosen(stratified_sample(df, 10, ["g"], ["id"], 1))) >= 5
    assert len([i for i in chosen(stratified_sample(df, 8, ["g"], ["id"], 1, "group")) if i < 5]) == 2


def test_units_cover_whole_group(spark):
    assert chosen(mus_sample(numbers(spark, [1, 2, 3]), 3, "v", ["id"], seed=1)) == [0, 1, 2]


def test_units_all_zero_is_a_random_draw(spark):
    assert len(chosen(mus_sample(numbers(spark, [0, 0, 0, 0]), 2, "v", ["id"], seed=1))) == 2


def test_units_too_few_positive_rows(spark):
    flagged = mus_sample(numbers(spark, [5, 0, 0, 0]), 2, "v", ["id"], seed=1)
    assert chosen(flagged) == [0]
    assert mus_shortfall(flagged, 2) == 1


def test_units_fewer_than_intervals(spark):
    flagged = mus_sample(numbers(spark, [0.01, 0.02] + [0] * 30), 10, "v", ["id"], seed=1)
    assert chosen(flagged) == [0, 1]


def test_units_threshold_and_negatives(spark):
    with pytest.raises(EmptyPopulationError):
        mus_sample(numbers(spark, [1, 9]), 1, "v", ["id"], threshold=10, seed=1)
    with pytest.raises(NegativeValueError):
        mus_sample(numbers(spark, [1, -9, 4]), 1, "v", ["id"], seed=1)
    assert chosen(mus_sample(numbers(spark, [1, -9000, 1]), 1, "v", ["id"], seed=1, negatives="abs")) == [1]
    assert 1 not in chosen(mus_sample(numbers(spark, [1, -9000, 1]), 2, "v", ["id"], seed=1, negatives="drop"))


def test_large_rows_are_always_hit(spark):
    values = [1.0] * 200 + [400.0, 500.0]
    for seed in range(5):
        assert {200, 201} <= set(chosen(mus_sample(numbers(spark, values), 20, "v", ["id"], seed=seed)))


def test_log1p_keeps_non_positive(spark):
    df = numbers(spark, [-2.0, 0.0, math.e - 1, None])
    got = [r[0] for r in df.orderBy("id").select(log1p_positive(F.col("v"))).collect()]
    assert got[:2] == [-2.0, 0.0] and abs(got[2] - 1) < 1e-12 and got[3] is None


def test_skewness_and_routes(spark):
    df = numbers(spark, [1.0, 2.0, 10.0]).withColumn("c", F.lit(3.0))
    assert abs(skewness(df, ["v"])["v"] - 0.674555) < 1e-5
    rows, plan = fit_features(df, ["v", "c"], [])
    assert not plan.log_route
    assert [r["c"] for r in plan.apply(rows).collect()] == [0.0] * 3


def test_one_hot_and_levels(spark):
    df = spark.createDataFrame([("B",), ("A",), (None,)], "c string")
    levels = distinct_levels(df, ["c"])["c"]
    got = df.select(*one_hot("c", levels)).collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 0), (0, 0)]
    with pytest.raises(ColumnError):
        distinct_levels(spark.range(500).withColumn("c", F.col("id").cast("string")), ["c"], 100)


def test_null_rules(spark):
    df = numbers(spark, [1.0, None, 3.0])
    with pytest.raises(ColumnError):
        fit_features(df, ["v"], [])
    assert fit_features(df, ["v"], [], nulls="drop")[0].count() == 2
    rows, plan = fit_features(df, ["v"], [], nulls="median")
    assert plan.apply(rows).where("v is null").count() == 0


def test_resolve_features():
    assert resolve_features(["v", "c_A", "c_B"], ["v", "c"]) == ["v", "c_A", "c_B"]


def clustered(spark, distances):
    rows = [(i, c, float(d)) for i, (c, d) in enumerate(distances)]
    return spark.createDataFrame(rows, "id bigint, cluster int, distance_to_centroid double")


def test_relative_distance(spark):
    got = relative_distance(clustered(spark, [(0, 1), (0, 2), (0, 3), (1, 5)])).orderBy("id").collect()
    assert [r["relative_distance"] for r in got] == [1.0, 2.0, 3.0, 0.0]


@pytest.mark.parametrize("quota, per_cluster", [(2, None), (2, 3), (1, 1)])
def test_cluster_quota(quota, per_cluster):
    assert cluster_quota(10, 4, per_cluster) == quota


def test_quota_fills_from_unselected(spark):
    df = clustered(spark, [(c, 1 + i % 7 + c) for c in range(4) for i in range(20)])
    flagged = quota_sample(relative_distance(df), 10, ["id"])
    got = {r["cluster"]: r["n"] for r in flagged.groupBy("cluster").agg(F.sum("is_sample").alias("n")).collect()}
    assert sum(got.values()) == 10 and min(got.values()) >= 2


def test_more_clusters_than_rows_asked(spark):
    df = clustered(spark, [(c, 1 + i) for c in range(6) for i in range(5)])
    assert len(chosen(quota_sample(relative_distance(df), 3, ["id"]))) == 3


@pytest.mark.parametrize("rows, sizes", [
    (999, [999]), (1_000, [1_000] * 3), (20_000, [2_000] * 3), (60_000, [5_000] * 3), (100_000, [5_000] * 3),
])
def test_silhouette_sizes(rows, sizes):
    assert silhouette_sizes(rows) == sizes


def test_noise_sampling(spark):
    noisy = spark.range(12).withColumn("is_anomaly", (F.col("id") < 5).cast("int"))
    some, text = noise_sample(noisy, 3, ["id"], 1)
    assert len(chosen(some)) == 3 and max(chosen(some)) < 5 and not text
    every, text = noise_sample(noisy, 9, ["id"], 1)
    assert chosen(every) == [0, 1, 2, 3, 4] and "5" in text
    with pytest.raises(NoAnomaliesError):
        noise_sample(noisy.withColumn("is_anomaly", F.lit(0)), 3, ["id"], 1)


def test_strata_comparison(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), ("A", 0), ("B", 0)], "g string, is_sample int")
    got = {r["stratum"]: (r["population_percent"], r["sample_percent"]) for r in strata_comparison(df, "g").collect()}
    assert got == {"A": (75.0, 100.0), "B": (25.0, 0.0)}


def test_thinned_curve_keeps_selected_points(spark):
    df = random_sample(spark.range(1_000).withColumn("v", F.col("id") * 1.5), 40, ["id"], 3)
    thin = cumulative_curve(df, "v", ["id"], max_points=100)
    assert thin.where("is_sample = 1").count() == 40 and thin.count() <= 145


def test_row_key_numbers_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("b", None)] * 3, "x string, y int")
    keyed = with_row_key(df, copies_per_task=4)
    assert keyed.count() == 28 and check_unique_key(keyed, ["row_key"])
    assert keyed.where("x = 'a'").count() == 25


def test_method_registry(spark):
    df = numbers(spark, [float(i % 17) for i in range(200)]).withColumn("g", F.col("id") % 3)
    found = run_method(df, 3, 20, ["id"], seed=1, strata=["g"], created="2024-01-01")
    assert found.sample.count() == 20 and found.comparison.count() == 3
    assert found.report().where("item = 'selected' and value = '20'").count() == 1
    assert run_method(df.drop("id"), "Random Sampling", 5, seed=1).sample.count() == 5
    with pytest.raises(RowLimitError):
        run_method(df, 1, 5, ["id"], max_rows=100)
    with pytest.raises(ValueError):
        run_method(df, 4, 5, ["id"])
    with pytest.raises(ValueError):
        run_method(df, "no such method", 5, ["id"])
    with pytest.raises(ValueError):
        run_method(df, 1, 5, ["id"], colour="red")
