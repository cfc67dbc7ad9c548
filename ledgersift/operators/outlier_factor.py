"""Local outlier factor (Breunig et al., 2000) as joins and aggregates over the neighbour table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import attach, require_rows, require_size, stored
from ..errors import SampleSizeError
from .neighbours import distinct_points, knn_join
from .order_statistics import top_n_by_score

NEIGHBOURS = 20
ANOMALY_FACTOR = 1.5


def local_outlier_factor(points: DataFrame, rows: int, k: int = NEIGHBOURS, **knn) -> DataFrame:
    """``pid, anomaly_score`` of distinct points."""
    k = max(1, min(k, rows - 1))
    near = stored(knn_join(points, k, **knn), "neighbours")
    radius = near.groupBy("a").agg(F.max("dist").alias("radius"))
    reach = F.greatest("dist", "radius") * F.col("take")
    density = (
        near.join(radius.withColumnRenamed("a", "b"), "b")
        .groupBy("a")
        .agg((F.lit(1.0) / (F.sum(reach) / F.sum("take") + F.lit(1e-10))).alias("density"))
    )
    density = stored(density, "densities")
    around = near.join(density.withColumnRenamed("a", "b"), "b").groupBy("a")
    mean = around.agg((F.sum(F.col("density") * F.col("take")) / F.sum("take")).alias("around"))
    return mean.join(density, "a").select(F.col("a").alias("pid"), (F.col("around") / F.col("density")).alias("anomaly_score"))


def lof_scores(df: DataFrame, vector: str, key: str, k: int = NEIGHBOURS, **knn) -> DataFrame:
    """Add ``anomaly_score`` to every row."""
    points = stored(distinct_points(df, vector, key), "points")
    rows = df.count()
    if rows < 2:
        raise SampleSizeError("at least two rows are needed")
    scores = local_outlier_factor(points, rows, k, **knn)
    scores = points.join(scores, "pid").select(F.col("v").alias(vector), "anomaly_score")
    return attach(df, stored(scores, "point-scores"), vector)


def lof_sample(
    df: DataFrame, vector: str, sample_size: int, key: str, k: int = NEIGHBOURS,
    pick: str = "most_anomalous", max_rows: int | None = None, **knn,
) -> DataFrame:
    """Add ``anomaly_score``, ``is_anomaly`` (above 1.5) and ``is_sample`` for n rows by score.

    ``pick='lowest'`` takes the least anomalous rows instead.
    """
    require_size(sample_size)
    require_rows(df, max_rows)
    scored = lof_scores(df, vector, key, k, **knn)
    scored = scored.withColumn("is_anomaly", (F.col("anomaly_score") > ANOMALY_FACTOR).cast("int"))
    return top_n_by_score(scored, "anomaly_score", sample_size, [key], pick != "lowest")
