"""The k-means search against plain runs from the same starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift.errors import SampleSizeError
from ledgersift.operators.clustering import kmeans_sample
from ledgersift.operators.kmeans_search import TOLERANCE, drawn_trials, kmeans_search, squared, uniform


def rows_of(seed=0, groups=5, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 3)) * 8
    x = centres[rng.integers(groups, size=n)] + rng.normal(size=(n, 3))
    x[: n // 3] = x[0]  # a third of all rows are copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def chain(points, weights, hashes, length, seed, s):
    """The k-means++ chain of a start, point by point."""
    chosen = np.zeros((0, points.shape[1]))
    for step in range(length):
        pull = weights * squared(points, chosen).min(axis=0) if len(chosen) else weights
        with np.errstate(divide="ignore"):
            time = np.where(pull > 0, -np.log(uniform(hashes, (seed * 1_000 + s) * 1_000 + step)) / pull, np.inf)
        chosen = np.vstack([chosen, points[[time.argmin()]]])
    return chosen


def plain_run(x, centres, bound, least):
    history = []
    for _ in range(bound + 1):
        d = ((x[:, None] - centres) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        history.append((d.min(axis=1).sum(), centres, len(set(label))))
        moved = np.array([x[label == k].mean(axis=0) if (label == k).any() else c for k, c in enumerate(centres)])
        if len(history) > 1 and resting:  # noqa: F821
            break
        resting = ((moved - centres) ** 2).sum() <= least  # noqa: F841
        centres = moved
    return history


def test_trials_and_winner_match_plain_runs(spark):
    x = rows_of()
    ranges = dict(clusters=range(2, 8), n_init=range(1, 4), max_iter=[1, 2, 50], trials=25)
    got = kmeans_search(frame(spark, x), "features", ["id"], 7, **ranges)
    hashes = {tuple(r["v"]): r["h"] for r in frame(spark, x).select(F.col("features").alias("v"), F.xxhash64("features").alias("h")).collect()}
    distinct = np.array(list(hashes))
    h = np.array(list(hashes.values()))
    weights = np.array([(x == p).all(axis=1).sum() for p in distinct]).astype(float)
    centred, distinct = x - x.mean(axis=0), distinct - x.mean(axis=0)
    total = (centred**2).sum()
    least = TOLERANCE * total / x.size
    tried = drawn_trials(7, 25, [*range(2, 8)], range(1, 4), [1, 2, 50])
    runs = {}
    wanted = {}
    for t in tried:
        ends = []
        for s in range(t.starts):
            if (t.clusters, s) not in runs:
                runs[t.clusters, s] = plain_run(centred, chain(distinct, weights, h, t.clusters, 7, s), 50, least)
            history = runs[t.clusters, s]
            ends.append(history[min(t.iterations, len(history) - 1)])
        within, centres, _ = min(ends, key=lambda e: e[0])
        wanted[t.number] = (((total - within) / (t.clusters - 1)) / (within / (len(x) - t.clusters)), centres, within)
    table = {r["trial"]: r for r in got.trials.collect()}
    assert set(table[0]["params"]) == {"n_clusters", "n_init", "max_iter"}
    assert all(np.isclose(table[n]["value"], v[0]) for n, v in wanted.items())
    best = max(tried, key=lambda t: (round(wanted[t.number][0], 6), -t.clusters, -t.number))
    assert got.settings.clusters == best.clusters and np.isclose(got.within, wanted[got.settings.number][2])
    assert np.allclose(got.centres, wanted[got.settings.number][1] + x.mean(axis=0))


def test_choice_depends_neither_on_partitions_nor_on_repetition(spark):
    x = rows_of(1)
    once = frame(spark, x)
    ten = once.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).select((F.col("id") * 10 + F.col("copy")).alias("id"), "features")
    ranges = dict(clusters=range(2, 9), n_init=[3], max_iter=[100], trials=12)
    a, b, c = (kmeans_search(d, "features", ["id"], 3, **ranges) for d in (once.repartition(1), once.repartition(7), ten))
    assert a.clusters == b.clusters == c.clusters == 5
    assert np.allclose(a.centres, b.centres) and np.allclose(a.centres, c.centres)
    assert np.isclose(10 * a.within, c.within)


def test_chance_of_a_start_follows_weight_and_distance():
    """Over many seeds the first centre is drawn by weight."""
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3)
    weights, wins = np.array([1.0, 2.0, 7.0]), np.zeros(3)
    for s in range(4_000):
        wins[(-np.log(uniform(h, s * 1_000)) / weights).argmin()] += 1
    assert np.allclose(wins / 4_000, weights / 10, atol=0.03)


def test_edges(spark):
    with pytest.raises(SampleSizeError):
        kmeans_search(frame(spark, np.zeros((0, 2))), "features", ["id"], 1)
    with pytest.raises(SampleSizeError):
        kmeans_search(frame(spark, np.zeros((2, 2))), "features", ["id"], 1)
    same = kmeans_search(frame(spark, np.ones((30, 2))), "features", ["id"], 1, trials=3)  # no spread: trials without a value
    assert same.trials.where("value IS NOT NULL").count() == 0 and same.clusters == 1
    flagged, trials = kmeans_sample(frame(spark, rows_of(2, n=90)), "features", 7, ["id"], 5, trials=4, n_init=[2], max_iter=[20])
    assert flagged.agg(F.sum("is_sample")).first()[0] == 7 and trials.count() == 4
