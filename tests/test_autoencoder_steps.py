"""Steps of the autoencoder against the formulas written out."""

import tracemalloc

import numpy as np
import pytest

from ledgersift.operators.autoencoder import BATCH, SLOPE, Gradients, forward, initial_weights, unpack


def plain(x, weights, output):
    layers = forward(x, weights, output)
    delta = 2 * (layers[-1] - x) / x.size
    if output == "sigmoid":
        delta = delta * layers[-1] * (1 - layers[-1])
    out = [None] * len(weights)
    for i in range(len(weights) - 2, -1, -2):
        out[i], out[i + 1] = layers[i // 2].T @ delta, delta.sum(axis=0)
        if i:
            delta = (delta @ weights[i].T) * np.where(layers[i // 2] > 0, 1.0, SLOPE)
    return out


@pytest.mark.parametrize("output", ["sigmoid", "linear"])
@pytest.mark.parametrize("rows", [1, 37, BATCH])
def test_gradients_have_the_bits_of_the_formulas(output, rows):
    flat = initial_weights(9, 3)
    weights, slopes = unpack(flat, 9), unpack(np.zeros_like(flat), 9)
    steps = Gradients(weights, output, rows)
    for seed in range(3):  # the arrays of one step serve the next, and weights move in place
        x = np.random.default_rng(seed).normal(size=(rows, 9)) * 10.0**seed
        steps(x, slopes)
        assert all((a == b).all() for a, b in zip(slopes, plain(x, weights, output), strict=True))
        flat -= 0.1 * np.concatenate([s.ravel() for s in slopes])


def test_a_step_keeps_its_arrays():
    flat = initial_weights(9, 3)
    weights, slopes, x = unpack(flat, 9), unpack(np.zeros_like(flat), 9), np.random.default_rng(0).random((BATCH, 9))
    steps, peaks = Gradients(weights, "sigmoid", BATCH), []
    for run in (lambda: steps(x, slopes), lambda: plain(x, weights, "sigmoid")):
        tracemalloc.start()
        try:
            run()
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[0] < peaks[1] / 3  # the second as before: an array for every operation
