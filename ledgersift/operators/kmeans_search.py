"""Search over k-means settings with all runs advancing together.

A trial is a number of clusters, a number of starts and a bound on iterations. Trials that ask for the same number of
clusters share their starts, so the work is one run per (clusters, start), and a trial is read off the runs'
histories: the lowest within-cluster sum among its first starts, each taken at its bound. All rows take part: equal
vectors are one weighted point, and every scan moves the centres of all open runs at once. A task sends the sums per
cluster, some runs a row, these are added per run, and only they reach the driver. A run leaves the scans when its
centres rest.

A scan of few columns takes points by leaves, neighbours in space that it adds as one where a centre is nearest to
the whole ball around them; the points of the other leaves are compared one by one. In many columns balls decide
nothing: there the centres of many runs are compared in one product of single precision, and points for which its
error could change the nearest centre once more in double precision.

Starts follow k-means++ as a race: in each step a point wins a chain with a chance in proportion to its weighted
squared distance, by hashed exponential draws whose minimum is an aggregate. A chain of the most clusters serves all
smaller ones, whose starts are its beginnings. Draws hang on the point alone, so neither the partitioning nor a table
that repeats all its rows changes a run. Distances are computed for points whose draw can still win.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import require_columns, stored
from ..errors import SampleSizeError
from .summaries import trial_table
from .vectors import matrix

K_RANGE = range(2, 21)
STARTS = range(5, 31)
ITERATIONS = range(100, 501)
TRIALS = 100
TOLERANCE = 1e-4  # of the mean variance of a column: less movement of the centres ends a run
BLOCK_VALUES = 1 << 20  # numbers in a stored block of points
CELLS = 1 << 16  # distances held at once, so that they stay in a core's cache
LEAF = 128  # points that a scan of few columns tries to add as one
LEAF_COLUMNS = 16
STACK, STRIP = 256, 1024  # centres and points in one product of a scan of many columns
SINGLE = 1e30  # squared lengths that single precision holds with room for sums
BUNDLE = 32  # runs whose sums travel in one row
FIRST_DRAWS = 256  # expected number of points whose times bound the winner's


@dataclass(frozen=True)
class Trial:
    number: int
    clusters: int
    starts: int
    iterations: int


@dataclass
class Run:
    """One start: its centres, and what every scan found of them."""

    clusters: int
    start: int
    bound: int
    centres: np.ndarray
    within: list[float] = field(default_factory=list)
    filled: list[int] = field(default_factory=list)
    kept: dict[int, np.ndarray] = field(default_factory=dict)
    resting: bool = False
    open: bool = True


@dataclass(frozen=True)
class KMeansChoice:
    """The winner: its centres (refitted with its own settings, on all rows) and the table of trials."""

    rows: int
    clusters: int
    centres: list[list[float]]
    trials: DataFrame
    within: float | None = None
    settings: Trial | None = None


def drawn_trials(
    seed: int, trials: int, clusters: Sequence[int], starts: Sequence[int], iterations: Sequence[int]
) -> list[Trial]:
    """Uniform draws of the three settings."""
    rng = np.random.default_rng(seed)
    picks = [(rng.choice(clusters), rng.choice(starts), rng.choice(iterations)) for _ in range(trials)]
    return [Trial(i, int(k), int(s), int(m)) for i, (k, s, m) in enumerate(picks)]


def leaf_order(x: np.ndarray) -> np.ndarray:
    """An order in which neighbours lie together: cut amid the widest column, which parts levels, again and again."""
    order, open_ = np.arange(len(x)), [(0, len(x))]
    while open_:
        low, high = open_.pop()
        if high - low <= LEAF:
            continue
        part = order[low:high]
        values = x[part]
        least, most = values.min(axis=0), values.max(axis=0)
        column = (most - least).argmax()
        left = values[:, column] <= least[column] + (most[column] - least[column]) / 2
        at = low + np.count_nonzero(left)
        if low < at < high:  # else all are alike
            order[low:high] = np.concatenate([part[left], part[~left]])
            open_ += [(low, at), (at, high)]
    return order


def _blocks(points: DataFrame, rows: int, dims: int) -> DataFrame:
    """Points (v, w, h) in binary blocks, which every scan reads as they are; few columns: close points together."""
    step, near = max(1, BLOCK_VALUES // dims), dims <= LEAF_COLUMNS

    def block(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        x, w, h = matrix(table["v"]), table["w"].to_numpy().astype(float), table["h"].to_numpy()
        for at in range(0, len(x), 2 * step):
            part = np.arange(at, min(len(x), at + 2 * step))
            if near:
                part = part[leaf_order(x[part])]
            yield pa.RecordBatch.from_arrays([pa.array([y[part].tobytes()], pa.binary()) for y in (x, w, h)], names=["x", "w", "h"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= step:
                yield from block(held)
                held, count = [], 0
        if count:
            yield from block(held)

    tasks = _tasks(points, rows, dims)
    placed = points.repartitionByRange(tasks, "v") if near else points.repartition(tasks, "h")
    return placed.select("v", "w", "h").mapInArrow(pack, "x binary, w binary, h binary")


def _opened(batches: Iterator[pa.RecordBatch], origin: np.ndarray, *others: str):
    """Centred points, their weights and the ``others`` of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, *rest = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64 if c == "h" else float) for c in ("x", "w", *others))
            yield x.reshape(-1, len(origin)) - origin, *rest


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, centres by points; never below zero."""
    d = (centres * centres).sum(axis=1)[:, None] - 2 * (centres @ x.T) + (x * x).sum(axis=1)
    return np.maximum(d, 0, out=d)


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Draws in (0, 1) that hang on a point's hash and the salt alone."""
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def race(x, w, h, chains: np.ndarray, seed: int, step: int):
    """(chain, time, hash, place) of the winners among some points; ``chains``: starts by centres by columns."""
    middle = x.mean(axis=0)
    radius, out = np.sqrt(squared(x, middle[None]).max()), []
    for s, centres in enumerate(chains):
        u = uniform(h, (seed * 1_000 + s) * 1_000 + step)

        def times(at: np.ndarray) -> np.ndarray:
            pull = w[at] * squared(x[at], centres).min(axis=0) if len(centres) else w[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(pull > 0, -np.log(u[at]) / pull, np.inf)

        # -log(u) is at least 1 - u, and no point is farther from its centre than the block's ball allows.
        least = (1 - u) / w
        far = (np.sqrt(squared(middle[None], centres).min()) + radius) ** 2 if len(centres) else 1.0
        first = times(np.flatnonzero(least <= FIRST_DRAWS / w.sum()))
        bound = first.min() if len(first) else np.inf
        at = np.flatnonzero(least <= bound * far * (1 + 1e-6)) if np.isfinite(bound) else np.arange(len(x))
        time = times(at)
        best = _first(time, h[at])
        if np.isfinite(time[best]):
            out.append((s, time[best], int(h[at[best]]), int(at[best])))
    return out


def _first(time: np.ndarray, h: np.ndarray) -> int:
    least = np.flatnonzero(time == time.min())
    return int(least[h[least].argmin()])


def _chains(blocks: DataFrame, origin: np.ndarray, starts: int, length: int, seed: int) -> list[np.ndarray]:
    """k-means++ chains; one ends early when all points are centres."""
    dims = len(origin)
    chains = [np.zeros((0, dims)) for _ in range(starts)]
    open_ = list(range(starts))
    for step in range(length):
        held = blocks.sparkSession.sparkContext.broadcast(chains)

        def run(batches: Iterator[pa.RecordBatch], step=step, held=held) -> Iterator[pa.RecordBatch]:
            won = {}
            for x, w, h in _opened(batches, origin, "h"):
                for s, time, name, at in race(x, w, h, held.value, seed, step):
                    won[s] = min(won.get(s, (np.inf, 0, b"")), (time, name, x[at].tobytes()))
            if won:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(won), pa.int32()), *(pa.array([v[i] for v in won.values()], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.binary())))],
                    names=["s", "time", "h", "x"],
                )

        found = blocks.mapInArrow(run, "s int, time double, h long, x binary").groupBy("s")
        found = found.agg(F.min(F.struct("time", "h", "x"))["x"].alias("x")).collect()  # one row a chain
        held.unpersist()
        won = {r["s"]: np.frombuffer(bytes(r["x"])) for r in found}
        open_ = [s for s in open_ if s in won]
        for s in open_:
            chains[s] = np.vstack([chains[s], won[s]])
        if not open_:
            break
    return chains


def cluster_sums(x: np.ndarray, lengths: np.ndarray, weighted: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """Per cluster the weight and the weighted sums of its points (ties to the lower cluster); the within sum.

    ``lengths``: squared lengths of the points; ``weighted``: their weights, and weights times columns.
    """
    d = centres @ x.T
    d *= -2
    d += (centres * centres).sum(axis=1)[:, None]
    best = d.min(axis=0)
    member = d == best
    if np.count_nonzero(member) != len(x):
        member = np.arange(len(centres))[:, None] == d.argmin(axis=0)
    return member.astype(float) @ weighted, float(weighted[:, 0] @ np.maximum(best + lengths, 0))


@dataclass
class Leaves:
    """Every ``LEAF`` points of a block, and what they come to as one weighted point."""

    points: np.ndarray  # leaves by points by columns
    weights: np.ndarray
    middles: np.ndarray
    weighted: np.ndarray
    radii: np.ndarray
    spreads: np.ndarray  # weighted squared distances to the middle

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray) -> Leaves:
        points, weights = x.reshape(-1, LEAF, x.shape[1]), w.reshape(-1, LEAF)
        total = weights.sum(axis=1)
        middles = np.einsum("lp,lpc->lc", weights, points) / total[:, None]
        lengths = ((points - middles[:, None]) ** 2).sum(axis=2)
        weighted = np.column_stack([total, total[:, None] * middles])
        return cls(points, weights, middles, weighted, np.sqrt(lengths.max(axis=1)), (weights * lengths).sum(axis=1))

    def sums(self, centres: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """(sums per cluster, within sum) of the leaves that a centre wins as a whole; which leaves these are.

        For x in the ball around m, x is nearer to c than to e if |m - e|^2 - |m - c|^2 > 2 * radius * |c - e|.
        """
        d = squared(self.middles, centres)
        best, place = d.argmin(axis=0), np.arange(d.shape[1])
        least = d[best, place]
        apart = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
        # Far above the rounding of the distances: a leaf in doubt is compared point by point.
        doubt = 1e-11 * ((self.middles * self.middles).sum(axis=1) + (centres * centres).sum(axis=1).max())
        clear = d - least > 2 * (1 + 1e-9) * self.radii * apart[:, best] + doubt
        clear[best, place] = True
        won = clear.all(axis=0)
        member = np.arange(len(centres))[:, None] == best[won]
        return member.astype(float) @ self.weighted[won], float(self.weighted[won, 0] @ least[won] + self.spreads[won].sum()), won


def _point_sums(x: np.ndarray, w: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """``cluster_sums`` of any number of points."""
    sums, within, step = np.zeros((len(centres), x.shape[1] + 1)), 0.0, max(1, CELLS // len(centres))
    for at in range(0, len(x), step):
        part, weight = x[at : at + step], w[at : at + step]
        more, far = cluster_sums(part, (part * part).sum(axis=1), np.column_stack([weight, weight[:, None] * part]), centres)
        sums, within = sums + more, within + far
    return sums, within


def leaf_sums(x: np.ndarray, w: np.ndarray, runs: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, float]]:
    """Sums per cluster and within sum of every run, by leaves."""
    whole = len(x) // LEAF * LEAF
    leaves = Leaves.of(x[:whole], w[:whole])
    for centres in runs:
        sums, within, won = leaves.sums(centres)
        for some, weights in ((leaves.points[~won].reshape(-1, x.shape[1]), leaves.weights[~won].ravel()), (x[whole:], w[whole:])):
            more, far = _point_sums(some, weights, centres)
            sums, within = sums + more, within + far
        yield sums, within


def stacked_sums(x: np.ndarray, w: np.ndarray, runs: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, float]]:
    """Sums per cluster and within sum of every run, the distances to many runs' centres in one product."""
    lengths = (x * x).sum(axis=1)
    if not max(lengths.max(), *((c * c).sum(axis=1).max() for c in runs)) < SINGLE:
        yield from (_point_sums(x, w, c) for c in runs)
        return
    weighted, total = np.column_stack([w, w[:, None] * x]), float(w @ lengths)
    narrow = np.column_stack([x, np.ones(len(x))]).T.astype(np.float32, order="C")
    at = 0
    while at < len(runs):
        some = [runs[at]]
        while at + len(some) < len(runs) and sum(map(len, some)) + len(runs[at + len(some)]) <= STACK:
            some.append(runs[at + len(some)])
        at += len(some)
        centres = np.concatenate(some)
        squares, sums = (centres * centres).sum(axis=1), np.zeros((len(centres), x.shape[1] + 1))
        spans = [slice(end - len(c), end) for c, end in zip(some, np.cumsum([len(c) for c in some]))]
        turned = np.column_stack([-2 * centres, squares]).astype(np.float32)
        # Twice the largest error of a distance in single precision (a bound that holds for any order of additions).
        longest = np.sqrt(squares.max())
        doubt = (2.1 * (x.shape[1] + 4) * 2.0**-24 * (2 * longest * np.sqrt(lengths) + longest**2) + 1e-36).astype(np.float32)
        member = np.empty((len(centres), STRIP))
        for low in range(0, len(x), STRIP):
            part = slice(low, low + STRIP)
            d = turned @ narrow[:, part]
            for span in spans:
                least = d[span].min(axis=0)
                least += doubt[part]
                near = d[span] <= least
                here = member[span, : near.shape[1]]
                here[:] = near
                if np.count_nonzero(near) != near.shape[1]:  # several are nearest within the error
                    open_ = np.flatnonzero(near.view(np.uint8).sum(axis=0, dtype=np.uint16) > 1)
                    exact = squares[span, None] - 2 * (centres[span] @ x[low + open_].T)
                    here[:, open_] = np.arange(len(near))[:, None] == exact.argmin(axis=0)
            sums += member[:, : d.shape[1]] @ weighted[part]
        for span, c in zip(spans, some):
            yield sums[span], max(0.0, total - 2 * float((c * sums[span, 1:]).sum()) + float(squares[span] @ sums[span, 0]))


def _scan(blocks: DataFrame, origin: np.ndarray, runs: list[Run]) -> dict[int, tuple[np.ndarray, float]]:
    """Sums of every open run over all points."""
    open_ = [i for i, r in enumerate(runs) if r.open]
    held = blocks.sparkSession.sparkContext.broadcast([runs[i].centres for i in open_])
    found = leaf_sums if len(origin) <= LEAF_COLUMNS else stacked_sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = []
        for x, w in _opened(batches, origin):
            more = list(found(x, w, held.value))
            total = [(a + c, b + d) for (a, b), (c, d) in zip(total, more)] or more
        task = TaskContext.get().partitionId()
        for at in range(0, len(total), BUNDLE):
            some = total[at : at + BUNDLE]
            row = [at // BUNDLE], [task], [b"".join(v[0].tobytes() for v in some)], [np.array([v[1] for v in some]).tobytes()]
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["bundle", "task", "sums", "within"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # the same order of additions, whichever task ends first
        whole = [pa.array([sum(np.frombuffer(x) for x in table[c].to_pylist()).tobytes()], pa.binary()) for c in ("sums", "within")]
        return pa.table([table["bundle"].slice(0, 1), *whole], names=["bundle", "sums", "within"])

    parts = blocks.select("x", "w").mapInArrow(run, "bundle int, task int, sums binary, within binary")
    rows = parts.groupBy("bundle").applyInArrow(add, "bundle int, sums binary, within binary").collect()  # a row for some runs
    held.unpersist()
    rows.sort(key=lambda r: r["bundle"])
    sums, within = (np.concatenate([np.frombuffer(bytes(r[c])) for r in rows]) for c in ("sums", "within"))
    ends = np.cumsum([runs[i].centres.size + len(runs[i].centres) for i in open_])
    split = np.split(sums, ends[:-1])
    return {i: (s.reshape(-1, len(origin) + 1), float(w)) for i, s, w in zip(open_, split, within)}


def advance(run: Run, sums: np.ndarray, within: float, least: float) -> None:
    """Record a scan of a run and move its centres; an empty cluster keeps its centre."""
    run.within.append(within)
    run.filled.append(int((sums[:, 0] > 0).sum()))
    if run.resting or len(run.within) > run.bound:
        run.open = False
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] / sums[:, :1], run.centres)
    run.resting = bool(((moved - run.centres) ** 2).sum() <= least)
    run.centres = moved


def calinski_harabasz_of(total: float, within: float, clusters: int, rows: float) -> float | None:
    if clusters < 2 or rows <= clusters or within <= 0:
        return None
    return ((total - within) / (clusters - 1)) / (within / (rows - clusters))


def kmeans_search(
    df: DataFrame, vector: str, key: Sequence[str], seed: int, clusters: Sequence[int] = K_RANGE,
    n_init: Sequence[int] = STARTS, max_iter: Sequence[int] = ITERATIONS, trials: int = TRIALS,
) -> KMeansChoice:
    """Best settings by the Calinski-Harabasz score over ``trials`` uniform draws; all rows, no subsample.

    ``clusters`` of the rows' number or more are not tried. A trial without a score (one cluster left, or no
    spread within clusters) is kept with an empty value; ties go to fewer clusters, then the earlier trial.
    """
    require_columns(df, vector, *key)
    points = df.groupBy(F.col(vector).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    points = stored(points.withColumn("h", F.xxhash64("v")), "kmeans-points")
    dims = points.select(F.size("v")).first()
    rows = points.agg(F.sum("w")).first()[0] or 0
    possible = [k for k in clusters if k < rows]
    if not possible:
        raise SampleSizeError("too few rows to cluster")
    dims = dims[0]
    blocks = stored(_blocks(points, rows, dims), "kmeans-blocks")
    whole = Run(1, 0, 0, np.zeros((1, dims)))
    mean = _scan(blocks, np.zeros(dims), [whole])[0][0][0, 1:] / rows
    total = _scan(blocks, mean, [whole])[0][1]
    tried = drawn_trials(seed, trials, possible, n_init, max_iter)
    chains = _chains(blocks, mean, max(t.starts for t in tried), max(t.clusters for t in tried), seed)
    runs = {}
    for t in tried:
        for s in range(t.starts):
            run = runs.setdefault((t.clusters, s), Run(t.clusters, s, 0, chains[s][: t.clusters]))
            run.bound = max(run.bound, t.iterations)
    marks = {k: {t.iterations for t in tried if t.clusters == k} for k in possible}
    every, least = list(runs.values()), TOLERANCE * total / rows / dims
    while any(r.open for r in every):
        for i, (sums, within) in _scan(blocks, mean, every).items():
            run = every[i]
            if len(run.within) in marks[run.clusters]:
                run.kept[len(run.within)] = run.centres
            advance(run, sums, within, least)
    scores = []
    for t in tried:
        ends = [(r.within[at], r.start, at, r) for r in (runs[t.clusters, s] for s in range(t.starts)) for at in [min(t.iterations, len(r.within) - 1)]]
        # Starts that end alike differ in rounding only: the first of them counts.
        within, _, at, run = min(ends, key=lambda e: (float(f"{e[0]:.9g}"), e[1]))
        scores.append((calinski_harabasz_of(total, within, run.filled[at], rows), within, at, run))
    scored = [(-float(f"{v[0]:.9g}"), t.clusters, t.number) for t, v in zip(tried, scores) if v[0] is not None]
    best = tried[min(scored)[2] if scored else 0]
    _, within, at, run = scores[best.number]
    centres = run.kept.get(at, run.centres) + mean
    table = [
        (t.number, {"n_clusters": float(t.clusters), "n_init": float(t.starts), "max_iter": float(t.iterations)}, v[0])
        for t, v in zip(tried, scores)
    ]
    return KMeansChoice(rows, len(centres), centres.tolist(), trial_table(df.sparkSession, table), within, best)


def _tasks(points: DataFrame, rows: int, dims: int) -> int:
    """Tasks of a scan: all cores, and no more than a few blocks each for large tables."""
    return max(points.sparkSession.sparkContext.defaultParallelism, rows * dims // (16 * BLOCK_VALUES))
