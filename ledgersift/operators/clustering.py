"""k-means selection: tuning, distances to centres, quotas per cluster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import bounded, require_size, spread, stored
from ..functions import seed_draw
from .kmeans_search import kmeans_search
from .order_statistics import top_n_by_score
from .vectors import matrix, squared_distances


def squared_distance(vector: Column, centre: Sequence[float]) -> Column:
    """Sum of squared differences to a fixed point, in codegen (no higher-order function)."""
    terms = [(F.get(vector, i) - F.lit(float(v))) * (F.get(vector, i) - F.lit(float(v))) for i, v in enumerate(centre)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


# Beyond this many differences one generated method would be too large to compile.
EXPRESSION_TERMS = 400


def nearest_centroid(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``cluster`` (lowest index on ties) and ``distance_to_centroid``.

    A plain expression for few centres and dimensions, distance blocks over Arrow batches otherwise.
    """
    if len(centres) * len(centres[0]) <= EXPRESSION_TERMS:
        pairs = [
            F.struct(squared_distance(F.col(vector), c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)
        ]
        best = F.array_min(F.array(*pairs))
    else:
        held = df.sparkSession.sparkContext.broadcast(np.array(centres, dtype=float))

        @F.arrow_udf("struct<d:double,c:int>")
        def closest(column: pa.Array) -> pa.Array:
            x = matrix(column)
            d = squared_distances(x, held.value) if len(x) else np.zeros((0, len(held.value)))
            return pa.StructArray.from_arrays(
                [pa.array(d.min(axis=1)), pa.array(d.argmin(axis=1).astype(np.int32))], names=["d", "c"]
            )

        best = closest(F.col(vector))
    return (
        df.withColumn("__best", best)
        .withColumn("cluster", F.col("__best.c"))
        .withColumn("distance_to_centroid", F.sqrt("__best.d"))
        .drop("__best")
    )


def cluster_distance_std(df: DataFrame) -> DataFrame:
    """Sample deviation of the distance per cluster; null for a single member."""
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.stddev_samp("distance_to_centroid").alias("distance_std")
    )


def relative_distance(df: DataFrame) -> DataFrame:
    """Add ``relative_distance`` = distance / deviation of its cluster; 0 where there is no spread."""
    spread = bounded(cluster_distance_std(df).select("cluster", "distance_std"))[0]
    ratio = F.coalesce(F.try_divide(F.col("distance_to_centroid"), F.col("distance_std")), F.lit(0.0))
    return df.join(spread, "cluster", "left").withColumn("relative_distance", ratio).drop("distance_std")


def cluster_quota(sample_size: int, clusters: int, per_cluster: int | None = None) -> int:
    """Rows taken from each cluster before filling up."""
    if per_cluster is not None and per_cluster * clusters <= sample_size:
        return per_cluster
    share = sample_size // clusters
    return share if per_cluster is not None else max(1, share)


def quota_sample(
    df: DataFrame, sample_size: int, key: Sequence[str], per_cluster: int | None = None, clusters: int | None = None
) -> DataFrame:
    """Flag the farthest rows of each cluster up to the quota, then the farthest of the rest.

    Fills from unselected rows only; a surplus (more clusters than rows asked) is cut by
    relative distance, not by cluster number.
    """
    require_size(sample_size)
    clusters = clusters or df.select("cluster").distinct().count()
    quota = cluster_quota(sample_size, clusters, per_cluster)
    if quota:
        first = top_n_by_score(df, "relative_distance", quota, key, True, ["cluster"])
    else:
        first = df.withColumn("is_sample", F.lit(0))
    first = first.withColumnRenamed("is_sample", "__first")
    taken = first.agg(F.sum("__first")).first()[0] or 0
    if taken == sample_size:
        return first.withColumnRenamed("__first", "is_sample")
    if taken > sample_size:
        pool, n = F.col("__first") == 1, sample_size
    else:
        pool, n = F.col("__first") == 0, sample_size - taken
    # Rows outside the pool score below every distance, so one cut serves the whole table.
    scored = first.withColumn("__score", F.when(pool, F.col("relative_distance")).otherwise(F.lit(-1.0)))
    flagged = top_n_by_score(scored, "__score", n, key, True)
    more = (F.col("is_sample") == 1) & (F.col("__score") >= 0)
    chosen = more if taken > sample_size else (F.col("__first") == 1) | more
    return flagged.withColumn("is_sample", chosen.cast("int")).drop("__first", "__score")


def calinski_harabasz(df: DataFrame, vector: str, cluster: str, dims: int) -> DataFrame:
    """[B / (k - 1)] / [W / (N - k)] from per-cluster sums and sums of squares: one pass over the rows."""
    # Moving the origin into the data keeps the sums of squares from cancelling.
    origin = df.select(vector).first()[0]
    parts = []
    for i in range(dims):
        x = F.get(F.col(vector), i).cast("double") - F.lit(float(origin[i]))
        parts += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    per_cluster = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *parts)
    squares = sum((F.col(f"q{i}") for i in range(1, dims)), F.col("q0"))
    centred = sum((F.col(f"s{i}") * F.col(f"s{i}") / F.col("n") for i in range(1, dims)), F.col("s0") * F.col("s0") / F.col("n"))
    shaped = per_cluster.withColumn("within", squares - centred).withColumn("centred", centred)
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)]
    whole = shaped.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("within").alias("within"),
        F.sum("centred").alias("centred"), *sums,
    )
    grand = sum((F.col(f"s{i}") * F.col(f"s{i}") / F.col("n") for i in range(1, dims)), F.col("s0") * F.col("s0") / F.col("n"))
    between = F.col("centred") - grand
    score = F.try_divide(between * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return whole.select(F.col("k").alias("clusters"), F.col("n").alias("rows"), score.alias("calinski_harabasz"))


def kmeans_sample(
    df: DataFrame, vector: str, sample_size: int, key: Sequence[str], seed: int | None = None,
    anomalies_per_cluster: int | None = None, **tuning,
) -> tuple[DataFrame, DataFrame]:
    """(flagged population, trials): rows farthest from their centre relative to the cluster's spread.

    ``tuning`` goes to ``kmeans_search``: ranges of ``clusters``, ``n_init`` and ``max_iter``, and ``trials``.
    """
    require_size(sample_size)
    choice = kmeans_search(df, vector, key, seed_draw() if seed is None else seed, **tuning)
    placed = stored(nearest_centroid(spread(df, choice.rows), vector, choice.centres), "clusters")
    flagged = quota_sample(
        relative_distance(placed), sample_size, key, anomalies_per_cluster, choice.clusters
    )
    return flagged, choice.trials
