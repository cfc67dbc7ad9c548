"""Scans and starts of the k-means search against plain sums over all points."""

import numpy as np

from ledgersift.operators import kmeans_search as search
from ledgersift.operators.kmeans_search import cluster_sums, leaf_order, leaf_sums, race, squared, stacked_sums, uniform


def plain(x, w, centres):
    return cluster_sums(x, (x * x).sum(axis=1), np.column_stack([w, w[:, None] * x]), centres)


def alike(got, wanted):
    return all(np.allclose(a[0], b[0], rtol=1e-12, atol=1e-9) and np.isclose(a[1], b[1], rtol=1e-11) for a, b in zip(got, wanted, strict=True))


def mixed_rows(rng, n):
    return np.column_stack([rng.lognormal(size=n), np.eye(4)[rng.integers(4, size=n)]])


def test_leaves_that_one_centre_wins_are_added_whole(monkeypatch):
    rng = np.random.default_rng(0)
    x, w = mixed_rows(rng, 20_050), rng.integers(1, 4, 20_050).astype(float)
    order = leaf_order(x)
    assert sorted(order) == list(range(len(x)))
    x, w = x[order], w[order]
    runs = [x[rng.integers(len(x), size=k)] for k in range(2, 9)]
    compared = []

    def counted(x, *others):
        compared.append(len(x))
        return cluster_sums(x, *others)

    monkeypatch.setattr(search, "cluster_sums", counted)
    assert alike(leaf_sums(x, w, runs), [plain(x, w, c) for c in runs])
    assert sum(compared) < 0.5 * len(x) * len(runs)  # before, every scan compared every point


def test_equal_centres_and_points_between_centres_go_to_the_lower_cluster():
    x = np.repeat([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], 200, axis=0)
    w = np.ones(len(x))
    runs = [np.array([[0.0, 0.0], [2.0, 0.0]]), np.array([[1.0, 0.0], [1.0, 0.0], [5.0, 5.0]])]
    for found in (leaf_sums, stacked_sums):
        for (sums, within), wanted, far in zip(found(x, w, runs), ([400, 200], [600, 0, 0]), (200, 400)):
            assert sums[:, 0].tolist() == wanted and np.isclose(within, far)


def test_stacked_runs_match_double_precision_where_single_cannot_tell():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(3_000, 24)), rng.integers(1, 4, 3_000).astype(float)
    close = rng.normal(size=24)
    runs = [np.vstack([close + 1e-9 * rng.normal(size=24) for _ in range(3)] + [rng.normal(size=24)]) for _ in range(5)]
    runs += [rng.normal(size=(k, 24)) for k in (1, 2, 20, 300)]
    for scale in (1.0, 1e-22, 1e25):  # the last two leave the range of single precision
        some = [c * scale for c in runs]
        for (sums, within), (wanted, far) in zip(stacked_sums(x * scale, w, some), [plain(x * scale, w, c) for c in some], strict=True):
            assert (sums[:, 0] == wanted[:, 0]).all() and np.allclose(sums[:, 1:] / scale, wanted[:, 1:] / scale, atol=1e-9)
            assert np.isclose(within, far, rtol=1e-9, atol=0)


def test_winner_of_a_race_needs_few_distances(monkeypatch):
    rng = np.random.default_rng(2)
    x, w, h = mixed_rows(rng, 9_000), rng.integers(1, 4, 9_000).astype(float), rng.integers(-(2**63), 2**63 - 1, 9_000)
    asked = []

    def counted(points, centres):
        asked.append(len(points))
        return squared(points, centres)

    monkeypatch.setattr(search, "squared", counted)
    for step in range(6):
        chains = [x[rng.integers(len(x), size=step)] for _ in range(5)]
        asked.clear()
        got = race(x, w, h, chains, 7, step)
        assert sum(asked) < 0.5 * len(x) * len(chains) + len(x)
        for (s, time, name, at), centres in zip(got, chains, strict=True):
            pull = w * squared(x, centres).min(axis=0) if step else w
            with np.errstate(divide="ignore"):
                times = np.where(pull > 0, -np.log(uniform(h, (7_000 + s) * 1_000 + step)) / pull, np.inf)
            assert at == times.argmin() and name == h[at] and np.isclose(time, times[at])
    assert race(x[:1], w[:1], h[:1], [x[:1]], 7, 1) == []  # all points are centres
