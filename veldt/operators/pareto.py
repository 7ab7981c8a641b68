"""Weights of several tasks' losses on the Pareto front, from their gradients."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram(gradients: DataFrame, tasks: list[str]) -> np.ndarray:
    """Inner products of all tasks' gradients, by one aggregate: a column per task, a row per parameter or block of parameters.

    A column holds numbers, or arrays of equal lengths within a row.  A null, or
    a shorter array's missing end, is a gradient of zero.
    """
    array = {t: isinstance(gradients.schema[t].dataType, T.ArrayType) for t in tasks}
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def product(a: str, b: str):
        if not array[a]:
            return zero(F.col(a)) * zero(F.col(b))
        return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: zero(x) * zero(y)), F.lit(0.0), lambda t, x: t + x), F.lit(0.0))

    if len(set(array.values())) > 1:
        raise ValueError("gradients must all be numbers or all be arrays")
    pairs = list(itertools.combinations_with_replacement(range(len(tasks)), 2))
    row = gradients.agg(*[F.coalesce(F.sum(product(tasks[i], tasks[j])), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(tasks), len(tasks)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"]
    return out


def on_simplex(x: np.ndarray, total: float) -> np.ndarray:
    """The nearest point to x with no negative element and the given sum."""
    ordered = np.sort(x)[::-1]
    over = (np.cumsum(ordered) - total) / np.arange(1, len(x) + 1)
    last = np.flatnonzero(ordered - over > 0)
    return np.maximum(x - over[last[-1]], 0.0) if len(last) else np.full(len(x), total / len(x))


def pareto_weights(products: np.ndarray, least: list[float]) -> np.ndarray:
    """Weights of at least `least` each, summing to 1, whose weighted gradient is shortest.

    The equations of the problem without signs are solved first (by least
    squares, where gradients depend on each other), then the nearest point with
    no weight below its least is taken.
    """
    c, k = np.array(least, float), len(least)
    if not 0 <= c.sum() < 1 or (c < 0).any():
        raise ValueError(f"least weights must not be negative and sum to less than 1, got {least}")
    if products.shape != (k, k):
        raise ValueError(f"{k} least weights for {len(products)} tasks")
    scale = np.abs(products).max() or 1.0  # the weights do not depend on it, the conditioning does
    g = products / scale
    system = np.block([[g, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    free = np.linalg.lstsq(system, np.r_[-g @ c, 1 - c.sum()], rcond=None)[0][:k]
    return on_simplex(free, 1 - c.sum()) + c


def pareto_table(gradients: DataFrame, tasks: list[str], least: list[float]) -> DataFrame:
    """(task, weight), one row per task."""
    weights = pareto_weights(gram(gradients, tasks), least)
    return gradients.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(tasks, weights)], "task string, weight double")
