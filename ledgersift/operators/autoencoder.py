"""Autoencoder selection by data-parallel local training (McMahan et al., 2017).

Each round broadcasts the weights; every partition trains on its own rows in
mini-batches as they stream through, and the weights are averaged by row count with
an aggregate. The driver only ever holds one set of weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import require_columns, require_size, spread, stored
from ..errors import SampleSizeError
from ..functions import seed_draw
from .order_statistics import top_n_by_score
from .vectors import matrix

# Fixed values of the network and its training.
HIDDEN, BOTTLENECK = 64, 3
SLOPE = 0.2
BATCH, EPOCHS = 64, 10
STEP, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-8

# Models trained side by side and averaged after every round. The number shapes the result, so it is an
# argument with a fixed default and never follows the table's size; raise it for tables of many millions.
WORKERS = 8


def layer_shapes(dims: int) -> list[tuple[int, ...]]:
    """Weights and offsets of dims-64-3-64-dims."""
    sizes = [dims, HIDDEN, BOTTLENECK, HIDDEN, dims]
    return [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]


def unpack(flat: np.ndarray, dims: int) -> list[np.ndarray]:
    """Views of one flat vector as the layers."""
    views, at = [], 0
    for shape in layer_shapes(dims):
        size = int(np.prod(shape))
        views.append(flat[at : at + size].reshape(shape))
        at += size
    return views


def initial_weights(dims: int, seed: int) -> np.ndarray:
    """Uniform Glorot weights and zero offsets, as one flat vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for shape in layer_shapes(dims):
        edge = np.sqrt(6 / sum(shape)) if len(shape) == 2 else 0.0
        parts.append(rng.uniform(-edge, edge, int(np.prod(shape))))
    return np.concatenate(parts)


def forward(x: np.ndarray, weights: Sequence[np.ndarray], output: str) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    layers = [x]
    for i in range(0, len(weights), 2):
        z = layers[-1] @ weights[i] + weights[i + 1]
        if i < len(weights) - 2:
            z = np.where(z > 0, z, SLOPE * z)
        elif output == "sigmoid":
            z = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        layers.append(z)
    return layers


class Gradients:
    """Gradient of the mean squared reconstruction error of batches of ``rows`` rows.

    All arrays of a step are kept for the next one: batches are small, and fresh arrays would cost more than sums.
    """

    def __init__(self, weights: Sequence[np.ndarray], output: str, rows: int):
        self.weights, self.output = weights, output
        self.turned = [w.T for w in weights[::2]]
        self.layers = [np.empty((rows, w.shape[1])) for w in weights[::2]]
        self.room = [np.empty_like(z) for z in self.layers]
        self.deltas = [np.empty_like(z) for z in self.layers]

    def __call__(self, x: np.ndarray, out: Sequence[np.ndarray]) -> None:
        """Written into ``out``, with the same operations on every number as ``forward``."""
        last, before = len(self.layers) - 1, x
        for i, (z, room) in enumerate(zip(self.layers, self.room)):
            np.matmul(before, self.weights[2 * i], out=z)
            z += self.weights[2 * i + 1]
            if i < last:
                np.multiply(z, SLOPE, out=room)
                np.maximum(z, room, out=z)
            elif self.output == "sigmoid":
                np.maximum(z, -60, out=z)
                np.minimum(z, 60, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.divide(1, z, out=z)
            before = z
        delta, room = self.deltas[last], self.room[last]
        np.subtract(before, x, out=delta)
        delta *= 2
        delta /= x.size
        if self.output == "sigmoid":
            delta *= before
            np.subtract(1, before, out=room)
            delta *= room
        for i in range(last, -1, -1):
            np.matmul((self.layers[i - 1] if i else x).T, delta, out=out[2 * i])
            np.add.reduce(delta, axis=0, out=out[2 * i + 1])
            if i:
                delta, room = np.matmul(delta, self.turned[i], out=self.deltas[i - 1]), self.room[i - 1]
                np.greater(self.layers[i - 1], 0, out=room)
                room *= 1 - SLOPE  # then 1 where positive, SLOPE elsewhere
                room += SLOPE
                delta *= room


def _train(batches, flat: np.ndarray, dims: int, seed: int, output: str):
    """One pass over a partition; returns the new weights and the rows seen."""
    flat = flat.copy()
    slope, first, second = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    weights, slopes = unpack(flat, dims), unpack(slope, dims)
    a, b, of_rows = np.empty_like(flat), np.empty_like(flat), {}
    rng = np.random.default_rng(seed)
    step = rows = 0
    for batch in batches:
        x = matrix(batch.column(0))
        x = x[rng.permutation(len(x))]
        for at in range(0, len(x), BATCH):
            step += 1
            some = x[at : at + BATCH]
            if len(some) not in of_rows:
                of_rows[len(some)] = Gradients(weights, output, len(some))
            of_rows[len(some)](some, slopes)
            np.subtract(slope, first, out=a)
            a *= 1 - BETA1
            first += a
            np.multiply(slope, slope, out=a)
            a -= second
            a *= 1 - BETA2
            second += a
            np.sqrt(second, out=a)
            a += EPSILON
            np.multiply(first, STEP * np.sqrt(1 - BETA2**step) / (1 - BETA1**step), out=b)
            b /= a
            flat -= b
        rows += len(x)
    return flat, rows


def fit_autoencoder(
    df: DataFrame, vector: str, key: Sequence[str], seed: int, epochs: int = EPOCHS,
    output: str = "sigmoid", workers: int = WORKERS, rows: int | None = None,
) -> np.ndarray:
    """Flat weights after ``epochs`` rounds. Rows are placed by key hash and sorted, so a seed repeats a run."""
    require_columns(df, vector, *key)
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    if not rows:
        raise SampleSizeError("no rows to train on")
    placed = df.select(vector, *key, F.pmod(F.xxhash64(*key), F.lit(workers)).cast("int").alias("worker"))
    parts = placed.repartition(workers, "worker").sortWithinPartitions("worker", F.xxhash64(*key), *key)
    parts = parts.select(vector).persist()
    dims = len(parts.first()[0])
    weights = initial_weights(dims, seed)
    try:
        for epoch in range(epochs):
            held = spark.sparkContext.broadcast(weights)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                flat, seen = _train(batches, held.value, dims, seed * 1_000 + epoch, output)
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen))],
                        names=["at", "weighted", "rows"],
                    )

            mean = (
                parts.mapInArrow(run, "at bigint, weighted double, rows bigint")
                .groupBy("at").agg((F.sum("weighted") / F.sum("rows")).alias("w"))
                .orderBy("at").toArrow()
            )
            weights = mean["w"].to_numpy()
    finally:
        parts.unpersist()
    return weights


def reconstruction_error(df: DataFrame, vector: str, weights: np.ndarray, output: str = "sigmoid") -> Column:
    """Mean squared difference between a row and its reconstruction."""
    held = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        x = matrix(column)
        error = np.zeros(0)
        if len(x):
            error = ((forward(x, unpack(held.value, x.shape[1]), output)[-1] - x) ** 2).mean(axis=1)
        # Matrix products may differ in the last bits with the batch size; scores must not.
        return pa.array(np.round(error, 9))

    return score(F.col(vector))


def autoencoder_sample(
    df: DataFrame, vector: str, sample_size: int, key: Sequence[str], seed: int | None = None,
    epochs: int = EPOCHS, output: str = "sigmoid", workers: int = WORKERS,
) -> DataFrame:
    """Add ``anomaly_score`` and ``is_sample`` for the n largest reconstruction errors."""
    require_size(sample_size)
    seed = seed_draw() if seed is None else seed
    rows = df.count()
    if sample_size > rows:
        raise SampleSizeError(f"sample size {sample_size} exceeds population size {rows}")
    weights = fit_autoencoder(df, vector, key, seed, epochs, output, workers, rows)
    scored = spread(df, rows).withColumn("anomaly_score", reconstruction_error(df, vector, weights, output))
    scored = stored(scored, "autoencoder-scores")
    return top_n_by_score(scored, "anomaly_score", sample_size, key, True)


def principal_axes(df: DataFrame, vector: str, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading axes (columns); the largest entry of an axis is positive, which fixes its sign."""
    dims = len(df.select(vector).first()[0])
    fitted = df.select(array_to_vector(F.col(vector)).alias("__x"))
    axes = PCA(k=min(components, dims), inputCol="__x", outputCol="__z").fit(fitted).pc.toArray()
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    mean = df.agg(*[F.avg(F.get(vector, i)) for i in range(dims)]).first()
    return np.array(mean, dtype=float), axes * np.sign(largest)


def coordinate(vector: str, origin: Sequence[float], axis: Sequence[float]) -> Column:
    """Position of a centred row along an axis."""
    terms = [(F.get(vector, i) - F.lit(float(o))) * F.lit(float(a)) for i, (o, a) in enumerate(zip(origin, axis))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def pca_reconstruction_sample(
    df: DataFrame, vector: str, sample_size: int, key: Sequence[str], components: int = BOTTLENECK
) -> DataFrame:
    """Linear counterpart: mean squared distance of a row to the span of the leading components."""
    require_size(sample_size)
    mean, axes = principal_axes(df, vector, components)
    placed = df
    for j in range(axes.shape[1]):
        placed = placed.withColumn(f"__z{j}", coordinate(vector, mean, axes[:, j]))
    error = F.lit(0.0)
    for i, m in enumerate(mean):
        rebuilt = F.lit(float(m))
        for j in range(axes.shape[1]):
            rebuilt = rebuilt + F.col(f"__z{j}") * F.lit(float(axes[i, j]))
        error = error + F.pow(F.get(vector, i) - rebuilt, 2)
    scored = placed.withColumn("anomaly_score", error / F.lit(float(len(mean))))
    scored = stored(scored.drop(*[f"__z{j}" for j in range(axes.shape[1])]), "pca-scores")
    return top_n_by_score(scored, "anomaly_score", sample_size, key, True)


def projection_2d(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with two principal coordinates ``x, y`` (a linear projection)."""
    mean, axes = principal_axes(df, vector, 2)
    return df.select(
        *keep, coordinate(vector, mean, axes[:, 0]).alias("x"), coordinate(vector, mean, axes[:, 1]).alias("y")
    )
