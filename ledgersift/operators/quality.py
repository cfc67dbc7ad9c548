"""Silhouette of a labelling: exact on bounded subsamples, squared-distance form on all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import require_rows
from .order_statistics import smallest_hashes
from .vectors import matrix, slices, squared_distances


# All pairs are compared, so the sample must stay small.
MAX_ROWS = 20_000


def silhouette_sizes(rows: int) -> list[int]:
    """Subsample sizes for a population of ``rows``."""
    if rows < 1_000:
        return [rows]
    if rows < 100_000:
        return [min(max(int(rows * 0.1), 1_000), 5_000)] * 3
    return [5_000] * 3


def silhouette_values(x: np.ndarray, points: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Silhouette of each row of ``x`` (cluster ``own``) among ``points`` (clusters ``codes``), which include it."""
    k = int(codes.max()) + 1
    member = np.zeros((len(points), k))
    member[np.arange(len(points)), codes] = 1
    sizes = member.sum(axis=0)
    out = np.zeros(len(x))
    for part in slices(len(x), len(points)):
        sums = np.sqrt(squared_distances(x[part], points)) @ member
        rows = np.arange(sums.shape[0])
        mine = own[part]
        inside = sums[rows, mine] / np.maximum(sizes[mine] - 1, 1)
        means = sums / sizes
        means[rows, mine] = np.inf
        outside = means.min(axis=1)
        widest = np.maximum(inside, outside)
        value = np.where(widest > 0, (outside - inside) / np.where(widest > 0, widest, 1), 0)
        out[part] = np.where(sizes[mine] > 1, value, 0)
    return out


def silhouette_rows(sample: DataFrame, vector: str, label: str, key: Sequence[str]) -> DataFrame:
    """``key..., silhouette`` of every row of a bounded sample; noise counts as a cluster."""
    require_rows(sample, MAX_ROWS)
    table = sample.select(vector, label, *key).orderBy(*key).toArrow()
    spark = sample.sparkSession
    held = spark.sparkContext.broadcast(table)
    schema = sample.select(*key).withColumn("silhouette", F.lit(0.0)).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = matrix(held.value[vector])
        codes = np.unique(held.value[label].to_numpy(), return_inverse=True)[1]
        for batch in batches:
            at = batch.column(0).to_numpy()
            score = silhouette_values(points[at], points, codes[at], codes)
            keys = held.value.select(list(key)).take(pa.array(at)).append_column("silhouette", pa.array(score))
            yield from keys.to_batches()

    parts = min(spark.sparkContext.defaultParallelism, max(1, table.num_rows // 250))
    return spark.range(0, table.num_rows, 1, parts).mapInArrow(measure, schema)


def subsample(df: DataFrame, size: int, key: Sequence[str], seed: int, number: int, rows: int) -> DataFrame:
    """Uniform subsample ``number`` of the given size."""
    if size >= rows:
        return df
    return smallest_hashes(df, size, key, seed, f"silhouette{number}", rows).where("is_sample = 1").drop("is_sample")


def silhouette(
    df: DataFrame, vector: str, key: Sequence[str], seed: int, label: str = "cluster",
    fit: Callable[[DataFrame], DataFrame] | None = None,
) -> float:
    """Mean silhouette over uniform subsamples; ``fit`` labels each subsample anew when given.

    Minus infinity when a subsample has fewer than two clusters besides noise (-1).
    """
    rows = df.count()
    scores = []
    for i, size in enumerate(silhouette_sizes(rows)):
        part = subsample(df, size, key, seed, i, rows)
        if fit is not None:
            part = fit(part)
        if part.where(F.col(label) != -1).select(label).distinct().limit(2).count() < 2:
            scores.append(float("-inf"))
            continue
        scores.append(silhouette_rows(part, vector, label, key).agg(F.avg("silhouette")).first()[0])
    return float(np.mean(scores))


def silhouette_squared(df: DataFrame, vector: str, label: str) -> float:
    """Silhouette on squared Euclidean distance over all rows, in linear time."""
    rows = df.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows)
