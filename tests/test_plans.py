"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from ledgersift.operators.features import fit_features
from ledgersift.operators.monetary import mus_sample, threshold_filter
from ledgersift.operators.random_sampling import random_sample, systematic_sample
from ledgersift.operators.ranking import global_rank, prefix_sum
from ledgersift.operators.stratified import stratified_sample


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SELECTIONS = {
    "random": lambda df: random_sample(df, 50, ["o_orderkey"], 5),
    "systematic": lambda df: systematic_sample(df, 50, ["o_orderdate"], ["o_orderkey"], 5),
    "stratified": lambda df: stratified_sample(df, 50, ["o_orderstatus"], ["o_orderkey"], 5),
    "units": lambda df: mus_sample(df, 50, "o_totalprice", ["o_orderkey"], seed=5),
    "rank": lambda df: global_rank(df, ["o_orderpriority"], ["o_orderkey"]),
    "running total": lambda df: prefix_sum(df, F.col("o_custkey"), ["o_orderdate"], ["o_orderkey"]),
}


@pytest.mark.parametrize("name", SELECTIONS)
def test_no_single_partition_and_no_python(orders, name):
    text = plan(SELECTIONS[name](orders))
    assert "SinglePartition" not in text
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_random_flag_needs_no_shuffle(orders):
    assert "Exchange" not in plan(random_sample(orders, 50, ["o_orderkey"], 5))


def test_stratified_flag_only_broadcasts_cuts(orders):
    text = plan(stratified_sample(orders, 50, ["o_orderstatus"], ["o_orderkey"], 5))
    assert "hashpartitioning" not in text and "BroadcastExchange" in text


def test_threshold_reaches_the_scan(orders):
    text = plan(threshold_filter(orders, "o_totalprice", 1000).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_totalprice,1000" in text
    assert "o_orderpriority" not in text


def test_features_are_one_projection(orders):
    rows, fitted = fit_features(orders, ["o_totalprice"], ["o_orderpriority"])
    text = plan(fitted.apply(rows, ["o_orderkey"]))
    assert "Exchange" not in text and "Python" not in text
