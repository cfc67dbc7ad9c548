"""Categories held as numbers of their levels, against the same columns spread out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.errors import ColumnError
from ledgersift.operators.features import fit_features, number_levels
from ledgersift.operators.isolation import grow_tree
from ledgersift.operators.outlier_factor import lof_scores
from ledgersift.operators.vectors import squared_distances
from ledgersift.plans import run_method


def rows(spark, n=300, levels=12):
    rng = np.random.default_rng(3)
    data = [(i, float(rng.normal()), None if i % 41 == 0 else f"l{rng.integers(levels):03d}", "hot" if i % 3 else f"g{i % 7}") for i in range(n)]
    return spark.createDataFrame(data, "id long, x double, a string, b string")


def test_distances_are_those_of_spread_columns():
    rng = np.random.default_rng(0)
    codes = rng.integers(-1, 4, size=(40, 2))
    plain = rng.normal(size=(40, 3))
    spread = np.hstack([plain, *[(codes[:, [j]] == np.arange(4)).astype(float) for j in range(2)]])
    held = np.hstack([plain, codes])
    assert np.allclose(squared_distances(held, held[:7], 2), squared_distances(spread, spread[:7]))


def test_numbers_follow_the_order_of_levels(spark):
    df = rows(spark)
    got, count = number_levels(df, "a", "number")
    names = sorted({r["a"] for r in df.collect()} - {None})
    assert count == len(names) and got.columns == [*df.columns, "number"] and got.count() == 300
    assert all(r["number"] == (-1 if r["a"] is None else names.index(r["a"])) for r in got.collect())
    none, count = number_levels(df.withColumn("a", F.lit(None).cast("string")), "a", "number")
    assert count == 0 and none.where("number = -1").count() == 300


def test_outlier_factors_do_not_depend_on_the_form(spark):
    df = rows(spark)
    spread, plan = fit_features(df, ["x"], ["a", "b"])
    held, numbered = fit_features(df, ["x"], ["a", "b"], max_levels=9, numbered=True)
    assert set(numbered.numbered) == {"a"} and set(numbered.levels) == {"b"} and numbered.numbered["a"] == len(plan.levels["a"])
    one = lof_scores(spread.select("id", plan.vector().alias("v")), "v", "id")
    for limits in ({}, {"broadcast_points": 0, "block_rows": 20}):
        two = lof_scores(held.select("id", numbered.vector().alias("v")), "v", "id", codes=1, **limits)
        a, b = ({r["id"]: r["anomaly_score"] for r in d.collect()} for d in (one, two))
        assert a.keys() == b.keys() and all(np.isclose(a[i], b[i], rtol=1e-9) for i in a)
    with pytest.raises(ColumnError):
        fit_features(df, ["x"], ["a", "b"], max_levels=9)


def test_splits_on_levels_are_as_frequent_as_on_their_columns():
    rng = np.random.default_rng(1)
    level = rng.integers(0, 5, size=200)
    plain = rng.normal(size=(200, 2))
    held = np.column_stack([plain, level])
    spread = np.column_stack([plain, level[:, None] == np.arange(5)]).astype(float)
    first = {0: np.zeros(3), 1: np.zeros(3)}
    for seed in range(400):
        for form, (x, codes) in enumerate(((held, 1), (spread, 0))):
            root = next(n for n in grow_tree(x, np.random.default_rng(seed), codes) if n[0] == 0)
            first[form][min(root[1], 2)] += 1
    assert np.abs(first[0] - first[1]).max() < 60 and first[0][2] > 200
    # A level that no other row has is split off at the root or never differs again.
    alone = np.column_stack([np.zeros(8), np.array([0, 0, 0, 0, 0, 0, 0, 1])])
    nodes = {n[0]: n for n in grow_tree(alone, np.random.default_rng(0), 1)}
    assert nodes[0][1] == 1 and {nodes[1][1], nodes[2][1]} == {-1}


@pytest.mark.parametrize("method", ["Isolation Forest", "Local Outlier Factor"])
def test_one_call_with_many_levels(spark, method):
    df = rows(spark, 400, 30)
    found = run_method(df, method, 10, ["id"], ["x"], ["a", "b"], seed=1, max_levels=9)
    assert found.population.count() == 400 and found.sample.count() == 10
    assert set(df.columns) <= set(found.population.columns) and not [c for c in found.population.columns if c.startswith("__")]
    assert ("a", "one column per value (30), held as the value's number") in found.features.describe()
    with pytest.raises(ColumnError):
        run_method(df, "Autoencoder", 10, ["id"], ["x"], ["a"], seed=1, max_levels=9)


def test_a_hundred_thousand_levels(spark):
    df = spark.range(200_000).selectExpr("id", "id % 100 / 50.0 AS x", "concat('level', id % 100000) AS a")
    found = run_method(df, 5, 40, ["id"], ["x"], ["a"], seed=2)
    assert found.features.numbered == {"a": 100_000} and found.features.levels == {}
    assert found.population.count() == 200_000 and found.sample.count() == 40
