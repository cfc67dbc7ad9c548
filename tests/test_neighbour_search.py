"""Neighbour joins on points that fill many blocks and cells, against brute force."""

import numpy as np
import pytest

from ledgersift.operators import neighbours
from ledgersift.operators.neighbours import (
    Projections, approximate_knn_search, blocks_to_visit, distinct_points, knn_search,
)
from ledgersift.operators.outlier_factor import lof_scores
from ledgersift.operators.vectors import squared_distances


def clouds(n, dims, seed, dense=0.35):
    """A third of the points in one dense cloud, some points repeated, the rest around a few centres."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 4
    x = centres[rng.integers(6, size=n)] + rng.normal(size=(n, dims))
    hot = rng.random(n) < dense
    x[hot] = centres[0] + 0.01 * rng.normal(size=(hot.sum(), dims))
    x[rng.integers(n, size=n // 20)] = x[0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def brute(x, k):
    """{pid: [(distance, b, take)]} over distinct points."""
    ids, weight = {}, {}
    for i, row in enumerate(map(tuple, x)):
        ids.setdefault(row, i)
        weight[row] = weight.get(row, 0) + 1
    rows, pids = np.array(list(ids)), np.array(list(ids.values()))
    w = np.array([weight[tuple(r)] for r in rows])
    out = {}
    for at, pid in enumerate(pids):
        gap = np.zeros(len(rows))
        for j in range(rows.shape[1]):
            gap += (rows[at, j] - rows[:, j]) ** 2
        d, have = np.sqrt(gap), w.copy()
        have[at] -= 1
        got, left = [], k
        for b in np.lexsort((pids, d)):
            if left > 0 and have[b]:
                got.append((d[b], int(pids[b]), min(left, int(have[b]))))
                left -= have[b]
        out[int(pid)] = got
    return out


def found(search):
    out = {}
    for r in search.pairs.collect():
        out.setdefault(r["a"], []).append((r["dist"], r["b"], r["take"]))
    return {a: sorted(v) for a, v in out.items()}


@pytest.mark.parametrize(("dims", "block_rows"), [(2, 16), (3, 40), (12, 32)])
def test_block_join_is_exact_and_skips_blocks(spark, dims, block_rows):
    x = clouds(1_200, dims, dims)
    search = knn_search(distinct_points(frame(spark, x), "features", "id"), 7, broadcast_points=0, block_rows=block_rows)
    wanted = brute(x, 7)
    got = found(search)
    assert got.keys() == wanted.keys()
    for a, pairs in wanted.items():
        assert [p[1:] for p in got[a]] == [p[1:] for p in pairs]
        assert np.allclose([p[0] for p in got[a]], [p[0] for p in pairs], rtol=1e-12)
    assert search.blocks > 20 and search.points <= search.visits < search.points * search.blocks * (0.4 if dims < 4 else 1)


def test_no_excluded_block_holds_a_nearer_point():
    rng = np.random.default_rng(2)
    centres, points = rng.normal(size=(8, 3)), rng.normal(size=(400, 3))
    d = np.sqrt(((points[:, None] - centres) ** 2).sum(axis=2))
    cell = d.argmin(axis=1)
    names = np.arange(8)
    near, far = (np.array([f(d[cell == c, c]) for c in names]) for f in (np.min, np.max))
    bound = np.full(400, 0.4)
    seen = set()
    for lo, hi in ((0, 2), (2, 4), (4, 8)):
        r, b = blocks_to_visit(points, cell, bound, centres, names, near, far, lo, hi)
        assert not seen & set(zip(r, b))
        seen |= set(zip(r, b))
    close = np.argwhere(np.sqrt(((points[:, None] - points) ** 2).sum(axis=2)) <= 0.4)
    assert {(a, cell[b]) for a, b in close} <= seen
    assert len(seen) < 400 * 8


def recall(search, wanted):
    got = found(search)
    shares = [sum(t for _, b, t in pairs if b in {p[1] for p in got.get(a, [])}) / sum(p[2] for p in pairs) for a, pairs in wanted.items()]
    return float(np.mean(shares))


def test_approximate_join_finds_what_its_audit_says(spark):
    x = clouds(3_000, 8, 4)
    points = distinct_points(frame(spark, x), "features", "id")
    search = approximate_knn_search(points, 5, cell_rows=64, tables=2)
    wanted = brute(x, 5)
    true = recall(search, wanted)
    assert search.recall >= 0.9 and abs(true - search.recall) < 0.06 and search.tables >= 2 and search.blocks > 100
    exact = {(a, b): d for a, pairs in wanted.items() for d, b, _ in pairs}
    got = found(search)
    assert all(np.isclose(d, exact[a, b]) for a, pairs in got.items() for d, b, _ in pairs if (a, b) in exact)
    # Per point no listed distance beats the exact one in its place.
    for a, pairs in got.items():
        assert all(d >= w[0] - 1e-12 for (d, *_), w in zip(pairs, wanted[a]))


def test_approximate_join_is_exact_in_one_cell_and_falls_back(spark):
    x = clouds(500, 4, 5)
    points = distinct_points(frame(spark, x), "features", "id")
    one = approximate_knn_search(points, 5)
    assert one.tables == 1 and one.recall == 1.0 and {a: [p[1:] for p in v] for a, v in found(one).items()} == {a: [p[1:] for p in v] for a, v in brute(x, 5).items()}
    never = approximate_knn_search(points, 5, recall=1.1, cell_rows=16, tables=1, max_tables=2)
    assert never.tables == 0 and recall(never, brute(x, 5)) == 1.0


def test_cells_across_the_nearest_boundaries():
    table = Projections(np.eye(2), np.array([[-1.0, 0.0, 1.0], [-1.0, 0.0, 1.0]]), np.ones(2))
    r, cell, own, further = table.cells(np.array([[0.1, 0.5], [-3.0, 0.9]]), 2)
    assert list(cell[own]) == [2 + 4 * 2, 0 + 4 * 2]
    assert {(int(a), int(b)) for a, b in zip(r[~own], cell[~own])} == {(0, 1 + 8), (0, 2 + 4 * 1), (1, 0 + 4 * 3), (1, 1 + 8)}
    assert list(further[:2]) == [0.6, -2.1]


def test_one_value_everywhere(spark):
    """Points that no projection can part: dealt by hash, and the audit turns to the exact join where it must."""
    x = np.array([[float(i), 0.0] for i in range(600)])
    points = distinct_points(frame(spark, x), "features", "id")
    search = approximate_knn_search(points, 2, cell_rows=32)
    assert recall(search, brute(x, 2)) >= 0.85


def test_outlier_factor_does_not_depend_on_the_path(spark):
    x = clouds(400, 5, 6)
    rows = frame(spark, x)
    few = {r["id"]: r["anomaly_score"] for r in lof_scores(rows, "features", "id").collect()}
    many = {r["id"]: r["anomaly_score"] for r in lof_scores(rows, "features", "id", broadcast_points=0, block_rows=20).collect()}
    assert few.keys() == many.keys() and all(np.isclose(few[i], many[i]) for i in few)


def test_points_that_no_bound_helps_are_swept(spark, monkeypatch):
    """Points all about as far from each other: no rounds over most blocks, the same neighbours."""
    seen, heavy = [], neighbours._swept
    monkeypatch.setattr(neighbours, "_swept", lambda points, asked, *rest: seen.append(asked.count()) or heavy(points, asked, *rest))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 40))
    x[rng.integers(700, size=40)] = x[0]
    search = knn_search(distinct_points(frame(spark, x), "features", "id"), 6, broadcast_points=0, block_rows=16)
    got, wanted = found(search), brute(x, 6)
    assert seen and seen[0] > 500 and search.visits > search.points
    assert {a: [p[1:] for p in v] for a, v in got.items()} == {a: [p[1:] for p in v] for a, v in wanted.items()}


def test_estimates_exclude_no_neighbour():
    """Candidates by matrix products against all distances, with own rows, weights, bounds, ties and a far origin."""
    rng = np.random.default_rng(3)
    points = 1e6 + rng.integers(0, 6, size=(9_000, 3)).astype(float) + rng.normal(size=(9_000, 3)) * (rng.random((9_000, 1)) < 0.5)
    x, weights, order = points[:50], rng.integers(1, 4, 9_000), rng.permutation(9_000)
    own = np.where(np.arange(50) < 40, np.arange(50), -1)
    bound = np.where(np.arange(50) % 3, np.inf, 0.2)
    got = list(zip(*neighbours.near_candidates(x, own, points, weights, order, 9, bound)))
    wanted = []
    for r, d in enumerate(np.sqrt(squared_distances(x, points))):
        if own[r] >= 0:
            d[own[r]] = np.inf
        left = 9
        for c in np.lexsort((order, d)):
            if left <= 0 or d[c] > bound[r]:
                break
            wanted.append((r, c, d[c]))
            left -= weights[c]
    assert got == wanted


def test_few_and_no_points(spark):
    none = distinct_points(frame(spark, np.zeros((0, 2))), "features", "id")
    one = distinct_points(frame(spark, np.zeros((1, 2))), "features", "id")
    for search in (knn_search, approximate_knn_search):
        assert search(none, 3).pairs.count() == 0
        assert search(one, 3).pairs.count() == 0
