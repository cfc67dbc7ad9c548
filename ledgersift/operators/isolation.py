"""Isolation forest (Liu, Ting & Zhou, 2008): parallel tree building, vectorised scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import require_columns, require_size, spread, stored
from ..errors import SampleSizeError
from ..functions import seed_draw
from .order_statistics import smallest_hashes, top_n_by_score
from .vectors import matrix

TREES = 100
TREE_ROWS = 256
SCORE_ROWS = 2_048
EULER = 0.5772156649015329


def average_path(n):
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator, codes: int = 0) -> list[tuple[int, int, float, float]]:
    """(node, feature or -1, threshold, path length); the children of node i are 2i + 1 and 2i + 2.

    The last ``codes`` columns are numbers of levels. Each level that some rows of a node have and others have not is
    a usable feature, as its one-hot column would be: rows of the level go right.
    """
    limit = math.ceil(math.log2(max(2, len(rows))))
    plain = rows.shape[1] - codes
    nodes, todo = [], [(0, np.arange(len(rows)), 0)]
    while todo:
        at, members, depth = todo.pop()
        x = rows[members]
        usable, levels = (), []
        if depth < limit and len(members) > 1:
            usable = np.flatnonzero(x[:, :plain].max(axis=0) > x[:, :plain].min(axis=0))
            for j in range(plain, plain + codes):
                found = np.unique(x[:, j])
                levels += [(j, v) for v in found if v >= 0] if len(found) > 1 else []
        if not len(usable) and not levels:
            nodes.append((at, -1, 0.0, depth + float(average_path(len(members)))))
            continue
        pick = int(rng.integers(len(usable) + len(levels))) if codes else 0
        if pick >= len(usable):
            feature, cut = levels[pick - len(usable)]
            right = x[:, feature] == cut
        else:
            feature = int(usable[pick] if codes else rng.choice(usable))
            column = x[:, feature]
            cut = float(rng.uniform(column.min(), column.max()))
            right = column > cut
        nodes.append((at, feature, float(cut), 0.0))
        todo.append((2 * at + 1, members[~right], depth + 1))
        todo.append((2 * at + 2, members[right], depth + 1))
    return nodes


def fit_forest(
    df: DataFrame, vector: str, key: Sequence[str], seed: int, trees: int = TREES, rows: int | None = None, codes: int = 0
) -> DataFrame:
    """Trees as a table ``tree, node, feature, threshold, path``; one task per slice of trees."""
    require_columns(df, vector, *key)
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    if not rows:
        raise SampleSizeError("no rows to fit")
    narrow = df.select(vector, *key)
    size = min(TREE_ROWS, rows)
    # A uniform draw of as many rows as all trees take; every tree draws its own sample from it.
    if rows > trees * size:
        narrow = smallest_hashes(narrow, trees * size, key, seed, "forest", rows).where("is_sample = 1")
    pool = spark.sparkContext.broadcast(matrix(narrow.orderBy(*key).select(vector).toArrow().column(0)))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                chosen = rng.choice(len(pool.value), size=size, replace=False)
                grown = grow_tree(pool.value[chosen], rng, codes)
                out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "path"])
                out.insert(0, "tree", int(tree))
                yield out

    schema = "tree int, node int, feature int, threshold double, path double"
    return spark.range(0, trees, 1, min(trees, spark.sparkContext.defaultParallelism)).mapInPandas(build, schema)


def forest_score(forest: DataFrame, rows: int, vector: str, codes: int = 0) -> Column:
    """Decision score of a row: 0.5 - 2^(-mean path / c(psi)); below 0 is anomalous."""
    # At most trees x 511 nodes whatever the population.
    nodes = forest.toPandas()
    size = min(TREE_ROWS, rows)
    scale = float(average_path(size)) or 1.0
    steps = math.ceil(math.log2(max(2, size)))
    trees = int(nodes["tree"].max()) + 1
    width = 2 ** (steps + 1) - 1
    # A leaf above the last level sends every row left until it gets there.
    feature = np.zeros((trees, width), dtype=np.int32)
    threshold = np.full((trees, width), np.inf)
    path = np.zeros((trees, width))
    for tree, node, f, cut, length in nodes.itertuples(index=False):
        if f >= 0:
            feature[tree, node], threshold[tree, node] = f, cut
        else:
            while node < 2**steps - 1:
                node = 2 * node + 1
            path[tree, node] = length
    model = forest.sparkSession.sparkContext.broadcast((feature, threshold, path))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        feature, threshold, path = model.value
        x = matrix(column)
        total = np.zeros(len(x))
        for start in range(0, len(x), SCORE_ROWS):
            part = x[start : start + SCORE_ROWS]
            values, base = part.ravel(), np.arange(len(part)) * x.shape[1]
            for f, t, p in zip(feature, threshold, path):
                at = np.zeros(len(part), dtype=int)
                for _ in range(steps):
                    own, cut = values.take(base + f.take(at)), t.take(at)
                    right = own > cut
                    if codes:
                        right = np.where(f.take(at) >= x.shape[1] - codes, own == cut, right)
                    at = 2 * at + 1 + right
                total[start : start + SCORE_ROWS] += p.take(at)
        return pa.array(0.5 - np.exp2(-total / len(feature) / scale))

    return score(F.col(vector))


def isolation_forest_sample(
    df: DataFrame, vector: str, sample_size: int, key: Sequence[str], seed: int | None = None, trees: int = TREES,
    codes: int = 0,
) -> DataFrame:
    """Add ``anomaly_score``, ``is_anomaly`` (score < 0) and ``is_sample`` for the n lowest scores.

    The last ``codes`` components of the vector are numbers of levels.
    """
    require_size(sample_size)
    seed = seed_draw() if seed is None else seed
    rows = df.count()
    if sample_size > rows:
        raise SampleSizeError(f"sample size {sample_size} exceeds population size {rows}")
    forest = fit_forest(df, vector, key, seed, trees, rows, codes)
    scored = spread(df, rows).withColumn("anomaly_score", forest_score(forest, rows, vector, codes))
    scored = stored(scored, "forest-scores").withColumn("is_anomaly", (F.col("anomaly_score") < 0).cast("int"))
    return top_n_by_score(scored, "anomaly_score", sample_size, key)
