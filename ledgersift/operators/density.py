"""Density clustering (Campello, Moulavi & Sander, 2013) and selection of its noise rows.

Distinct weighted points, neighbour join, core distances, then a minimum spanning
forest of the mutual reachability graph: by rounds of nearest-foreign-point search
over point blocks when the points fit a broadcast (exact), otherwise by filter and
merge (Lattanzi et al., 2011) over the neighbour graph. The cluster tree is read off
the forest's n - 1 edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import attach, require_rows, require_size, stored
from ..errors import NoAnomaliesError, RowLimitError, SampleSizeError
from ..functions import seed_draw
from .neighbours import BROADCAST_POINTS, distinct_points, knn_join
from .order_statistics import smallest_hashes
from .quality import silhouette_sizes, silhouette_values, subsample
from .ranking import global_rank
from .summaries import trial_table
from .vectors import matrix, slices, squared_distances

GRAPH_NEIGHBOURS = 20
EDGES_PER_GROUP = 1_000_000
# The tree is read in one task from one edge per distinct point.
MAX_POINTS = 5_000_000
FLOOR = 1e-12


@dataclass(frozen=True)
class DensitySettings:
    min_cluster_size: int = 5
    min_samples: int = 5
    epsilon: float = 0.0
    alpha: float = 1.0


class Sets:
    """Disjoint sets with path halving."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int, root: int | None = None) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        root = min(a, b) if root is None else root
        self.parent[a] = self.parent[b] = root
        return True


def merge_tree(ends: np.ndarray, lengths: np.ndarray, sizes: np.ndarray):
    """Children, height and size of every node; leaves first, one root (unlinked parts meet at infinity)."""
    n = len(sizes)
    sets = Sets(2 * n - 1)
    children = [(-1, -1)] * (2 * n - 1)
    height, size = np.zeros(2 * n - 1), np.concatenate([sizes, np.zeros(n - 1, dtype=sizes.dtype)])
    at = n

    def link(a: int, b: int, length: float) -> None:
        nonlocal at
        a, b = sets.find(a), sets.find(b)
        if a != b:
            children[at], height[at], size[at] = (a, b), length, size[a] + size[b]
            sets.join(a, b, at)
            at += 1

    for i in np.lexsort((ends[:, 1], ends[:, 0], lengths)):
        link(int(ends[i, 0]), int(ends[i, 1]), float(lengths[i]))
    for leaf in range(1, n):
        link(0, leaf, math.inf)
    return children, height, size


def cluster_labels(ends, lengths, sizes, cores, settings: DensitySettings) -> np.ndarray:
    """Cluster of each point by excess of mass, -1 for noise; the whole set is never one cluster."""
    n, smallest = len(sizes), settings.min_cluster_size
    if n == 1:
        return np.full(1, -1)
    children, height, size = merge_tree(ends, lengths, sizes)

    def level(distance: float) -> float:
        return 1 / max(distance, FLOOR)

    parent, birth, stability = [-1], [0.0], [0.0]
    home = np.zeros(n, dtype=int)
    todo = [(2 * n - 2, 0)]

    def release(node: int, cluster: int, when: float) -> None:
        stability[cluster] += (when - birth[cluster]) * size[node]
        leaves = [node]
        while leaves:
            x = leaves.pop()
            if x < n:
                home[x] = cluster
            else:
                leaves.extend(children[x])

    while todo:
        node, cluster = todo.pop()
        if node < n:
            release(node, cluster, level(cores[node]))
            continue
        when = level(height[node])
        big = [c for c in children[node] if size[c] >= smallest]
        for c in children[node]:
            if size[c] < smallest:
                release(c, cluster, when)
            elif len(big) == 1:
                todo.append((c, cluster))
            else:
                stability[cluster] += (when - birth[cluster]) * size[c]
                parent.append(cluster)
                birth.append(when)
                stability.append(0.0)
                todo.append((c, len(parent) - 1))

    count = len(parent)
    below = [0.0] * count
    chosen = [False] * count
    best = list(stability)
    inner = [False] * count
    for c in range(count - 1, 0, -1):
        chosen[c] = not inner[c] or stability[c] >= below[c]
        best[c] = stability[c] if chosen[c] else below[c]
        below[parent[c]] += best[c]
        inner[parent[c]] = True
    top = [-1] * count
    for c in range(1, count):
        above = top[parent[c]]
        top[c] = above if above >= 0 else (c if chosen[c] else -1)
    if settings.epsilon > 0:
        lifted = {}
        for c in sorted({t for t in top if t >= 0}):
            x = c
            while 1 / max(birth[x], FLOOR) < settings.epsilon and parent[x] > 0:
                x = parent[x]
            lifted[c] = x
        picked = set(lifted.values())
        top = [-1] * count
        for c in range(1, count):
            above = top[parent[c]]
            top[c] = above if above >= 0 else (c if c in picked else -1)
    names = {c: i for i, c in enumerate(sorted({t for t in top if t >= 0}))}
    return np.array([names.get(top[h], -1) for h in home])


def core_distances(points: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """``pid, v, w, core``: distance to the ``min_samples``-th nearest row, the row itself included."""
    wanted = min_samples - 1
    ranked = Window.partitionBy("a").orderBy("dist", "b").rowsBetween(Window.unboundedPreceding, -1)
    inside = near.withColumn("__before", F.coalesce(F.sum("take").over(ranked), F.lit(0))).where(F.col("__before") < wanted)
    core = inside.groupBy("a").agg(F.max("dist").alias("core"))
    joined = points.join(core.withColumnRenamed("a", "pid"), "pid", "left")
    return joined.select("pid", "v", "w", F.coalesce("core", F.lit(0.0)).alias("core"))


def spanning_tree(points: DataFrame, alpha: float) -> DataFrame:
    """Exact minimum spanning tree ``i, j, length`` (indices in pid order) of points that fit a broadcast.

    Every round finds the shortest link that leaves each component, in parallel over
    points, so rounds grow with the logarithm of the number of points.
    """
    spark = points.sparkSession
    table = points.orderBy("pid").toArrow()
    held = spark.sparkContext.broadcast((matrix(table["v"]), table["core"].to_numpy()))
    n = table.num_rows
    sets, component = Sets(n), np.arange(n)
    links: list[tuple[int, int, float]] = []
    numbered = spark.range(0, n, 1, spark.sparkContext.defaultParallelism)
    while len(links) < n - 1:
        current = spark.sparkContext.broadcast(component)

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, core = held.value
            home = current.value
            for batch in batches:
                own = batch.column(0).to_numpy()
                found = []
                for part in slices(len(own), n):
                    rows = own[part]
                    d = np.sqrt(squared_distances(x[rows], x)) / alpha
                    np.maximum(d, core[None, :], out=d)
                    np.maximum(d, core[rows, None], out=d)
                    d[home[rows, None] == home[None, :]] = np.inf
                    other = d.argmin(axis=1)
                    found.append(pd.DataFrame({
                        "home": home[rows], "length": d[np.arange(len(rows)), other],
                        "i": np.minimum(rows, other), "j": np.maximum(rows, other),
                    }))
                best = pd.concat(found).sort_values(["home", "length", "i", "j"]).drop_duplicates("home")
                yield pa.RecordBatch.from_pandas(best, preserve_index=False)

        shortest = (
            numbered.mapInArrow(leave, "home bigint, length double, i bigint, j bigint")
            .groupBy("home").agg(F.min(F.struct("length", "i", "j")).alias("m"))
            .select("m.*").distinct().orderBy("length", "i", "j").collect()
        )
        for length, i, j in shortest:
            if sets.join(i, j):
                links.append((i, j, length))
        component = np.array([sets.find(x) for x in range(n)])
    frame = pd.DataFrame(links, columns=["i", "j", "length"])
    return spark.createDataFrame(frame, "i bigint, j bigint, length double")


def kruskal(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges of the minimum spanning forest of one group of edges."""
    frame = frame.sort_values(["length", "i", "j"])
    codes, _ = pd.factorize(pd.concat([frame["i"], frame["j"]]))
    a, b = codes[: len(frame)], codes[len(frame) :]
    sets = Sets(int(codes.max()) + 1 if len(codes) else 0)
    return frame[[sets.join(int(x), int(y)) for x, y in zip(a, b)]]


def spanning_forest(edges: DataFrame, edges_per_group: int = EDGES_PER_GROUP) -> DataFrame:
    """Minimum spanning forest by filter and merge: forests of edge groups, regrouped until one is left."""
    edges = stored(edges, "edges")
    count = edges.count()
    groups = max(1, -(-count // edges_per_group))
    while True:
        slot = F.pmod(F.xxhash64("i", "j"), F.lit(groups)).alias("__slot")
        edges = edges.groupBy(slot).applyInPandas(lambda frame: kruskal(frame[["i", "j", "length"]]), edges.schema)
        edges = stored(edges, "forest")
        if groups == 1:
            return edges
        groups = max(1, groups // 4)


def density_labels(
    points: DataFrame, settings: DensitySettings, near: DataFrame | None = None,
    broadcast_points: int = BROADCAST_POINTS, max_points: int = MAX_POINTS,
) -> DataFrame:
    """``pid, cluster`` of distinct weighted points; -1 is noise."""
    if near is None:
        near = stored(knn_join(points, max(GRAPH_NEIGHBOURS, settings.min_samples), broadcast_points), "neighbours")
    count = points.count()
    if count > max_points:
        raise RowLimitError(f"{count} distinct points exceed {max_points}")
    cored = stored(core_distances(points, near, settings.min_samples), "cores")
    one = F.lit(0).alias("one")
    if count <= broadcast_points:
        ids = Window.partitionBy("one").orderBy("pid")
        tree = spanning_tree(cored, settings.alpha)
        indexed = cored.select("pid", "w", "core", one).withColumn("at", F.row_number().over(ids) - 1)
    else:
        ranked = stored(global_rank(cored.drop("v"), ["pid"], ["pid"], rows=count), "ranked")
        indexed = ranked.select("pid", "w", "core", one, F.col("position").alias("at"))
        left = ranked.select(F.col("pid").alias("a"), F.col("core").alias("ca"), F.col("position").alias("pa"))
        right = ranked.select(F.col("pid").alias("b"), F.col("core").alias("cb"), F.col("position").alias("pb"))
        length = F.greatest("ca", "cb", F.col("dist") / F.lit(settings.alpha))
        edges = near.where("a <> b").join(left, "a").join(right, "b")
        edges = edges.select(F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j"), length.alias("length"))
        tree = spanning_forest(edges.distinct())
    kind = points.schema["pid"].dataType.simpleString()

    def label(nodes: pa.Table, links: pa.Table) -> pa.Table:
        order = np.argsort(nodes["at"].to_numpy())
        ends = np.column_stack([links["i"].to_numpy(), links["j"].to_numpy()]) if links.num_rows else np.zeros((0, 2), int)
        found = cluster_labels(
            ends, links["length"].to_numpy() if links.num_rows else np.zeros(0),
            nodes["w"].to_numpy()[order], nodes["core"].to_numpy()[order], settings,
        )
        pids = nodes["pid"].combine_chunks().take(pa.array(order))
        return pa.table({"pid": pids, "cluster": pa.array(found.astype(np.int32))})

    groups = indexed.groupBy("one").cogroup(tree.withColumn("one", F.lit(0)).groupBy("one"))
    return groups.applyInArrow(label, f"pid {kind}, cluster int")


def density_clusters(df: DataFrame, vector: str, key: str, settings: DensitySettings, **limits) -> DataFrame:
    """Add ``cluster`` (-1 noise) and ``is_anomaly`` to every row."""
    points = stored(distinct_points(df, vector, key), "points")
    labels = density_labels(points, settings, **limits)
    labels = stored(points.join(labels, "pid").select(F.col("v").alias(vector), "cluster"), "labels")
    return attach(df, labels, vector).withColumn("is_anomaly", (F.col("cluster") == -1).cast("int"))


def noise_sample(labelled: DataFrame, sample_size: int, key: Sequence[str], seed: int) -> tuple[DataFrame, str]:
    """Flag n noise rows at random, or all of them with a warning if there are no more than n."""
    require_size(sample_size)
    noise = labelled.agg(F.count_if(F.col("is_anomaly") == 1)).first()[0]
    if not noise:
        raise NoAnomaliesError("no noise rows were found")
    if noise <= sample_size:
        text = f"only {noise} anomalies found, sample size {sample_size}" if noise < sample_size else ""
        return labelled.withColumn("is_sample", F.col("is_anomaly")), text
    return smallest_hashes(labelled, sample_size, key, seed, "noise", noise, F.col("is_anomaly") == 1), ""


def dense_tree(x: np.ndarray, cores: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Minimum spanning tree of one bounded subsample, grown point by point."""
    n = len(x)
    best, source = np.full(n, np.inf), np.zeros(n, dtype=int)
    outside = np.ones(n, dtype=bool)
    ends, lengths, at = np.zeros((n - 1, 2), dtype=int), np.zeros(n - 1), 0
    for step in range(n - 1):
        outside[at] = False
        d = np.sqrt(squared_distances(x[at : at + 1], x)[0]) / alpha
        d = np.maximum(np.maximum(d, cores), cores[at])
        closer = outside & (d < best)
        best[closer], source[closer] = d[closer], at
        at = int(np.where(outside, best, np.inf).argmin())
        ends[step], lengths[step] = (source[at], at), best[at]
    return ends, lengths


def trial_settings(trials: int, seed: int) -> list[DensitySettings]:
    """Seeded random grid: cluster size 2..20, samples 1..20, epsilon 0..1, alpha in (0, 2]."""
    rng = np.random.default_rng(seed)
    return [
        DensitySettings(
            int(rng.integers(2, 21)), int(rng.integers(1, 21)), float(rng.uniform(0, 1)), 2 - float(rng.uniform(0, 2))
        )
        for _ in range(trials)
    ]


def tune_density(
    df: DataFrame, vector: str, key: Sequence[str], seed: int, trials: int = 100
) -> tuple[DensitySettings, DataFrame]:
    """Best of random settings by mean silhouette over bounded subsamples, clustered anew in each trial.

    One task per (trial, subsample); the subsamples (at most 5,000 rows each) and their
    neighbour distances are broadcast once.
    """
    spark = df.sparkSession
    rows = df.count()
    if rows < 3:
        raise SampleSizeError("too few rows to tune")
    subsamples = []
    for i, size in enumerate(silhouette_sizes(rows)):
        part = subsample(df.select(vector, *key), size, key, seed, i, rows)
        subsamples.append(matrix(part.orderBy(*key).select(vector).toArrow()[vector]))
    held = spark.sparkContext.broadcast(subsamples)
    grid = trial_settings(trials, seed)
    widest = max(s.min_samples for s in grid)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, at in zip(batch["sub"], batch["slice"]):
                x = held.value[i]
                rows_at = np.arange(at * 250, min(len(x), at * 250 + 250))
                d = np.sqrt(squared_distances(x[rows_at], x))
                d = np.sort(np.partition(d, min(widest, len(x)) - 1, axis=1)[:, :widest], axis=1)
                yield pd.DataFrame({"sub": i, "at": rows_at, "d": list(d)})

    work = [(i, s) for i, x in enumerate(subsamples) for s in range(-(-len(x) // 250))]
    tasks = spark.createDataFrame(work, "sub int, slice int").repartition(len(work), "sub", "slice")
    near = tasks.mapInPandas(neighbours, "sub int, at bigint, d array<double>").orderBy("sub", "at").toArrow()
    which = near["sub"].to_numpy()
    distances = matrix(near["d"])
    nearest = spark.sparkContext.broadcast([distances[which == i] for i in range(len(subsamples))])

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, i in zip(batch["trial"], batch["sub"]):
                settings, x = grid[t], held.value[i]
                cores = nearest.value[i][:, min(settings.min_samples, len(x)) - 1]
                ends, lengths = dense_tree(x, cores, settings.alpha)
                found = cluster_labels(ends, lengths, np.ones(len(x), dtype=int), cores, settings)
                score = -np.inf
                if len(set(found) - {-1}) > 1:
                    codes = np.unique(found, return_inverse=True)[1]
                    score = silhouette_values(x, x, codes, codes).mean()
                yield pd.DataFrame({"trial": [t], "sub": [i], "score": [score]})

    work = [(t, i) for t in range(trials) for i in range(len(subsamples))]
    tasks = spark.createDataFrame(work, "trial int, sub int").repartition(len(work), "trial", "sub")
    scores = tasks.mapInPandas(attempt, "trial int, sub int, score double")
    means = dict(scores.groupBy("trial").agg(F.avg("score")).collect())
    best = max(range(trials), key=lambda t: (means[t], -t))
    lines = [
        (t, {
            "min_cluster_size": float(s.min_cluster_size), "min_samples": float(s.min_samples),
            "cluster_selection_epsilon": s.epsilon, "alpha": s.alpha,
        }, float(means[t]) if np.isfinite(means[t]) else None)
        for t, s in enumerate(grid)
    ]
    return grid[best], trial_table(spark, lines)


def density_cluster_sample(
    df: DataFrame, vector: str, sample_size: int, key: str, seed: int | None = None,
    settings: DensitySettings | None = None, trials: int = 100, max_rows: int | None = None, **limits,
) -> tuple[DataFrame, DataFrame | None, str]:
    """(flagged population, trials, warning): a random choice among the rows labelled noise.

    A population without noise rows comes back labelled, with no row chosen and a warning.
    """
    require_size(sample_size)
    require_rows(df, max_rows)
    seed = seed_draw() if seed is None else seed
    study = None
    if settings is None:
        settings, study = tune_density(df, vector, [key], seed, trials)
    labelled = density_clusters(df, vector, key, settings, **limits)
    try:
        flagged, warning = noise_sample(labelled, sample_size, [key], seed)
    except NoAnomaliesError as none:
        flagged, warning = labelled.withColumn("is_sample", F.lit(0)), str(none)
    return flagged, study, warning
