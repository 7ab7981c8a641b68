"""Scoring rows with dense models of given weights: towers, cross networks, interactions and mixtures of experts.

Weights are a table of matrix rows, checked in size, collected once and
broadcast once.  A model is a list of steps; each takes and gives one matrix per
Arrow batch, so a layer is one matrix product for all rows of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matrices import matrix_of

WEIGHTS = "name string, i int, v array<double>"
#: Every worker holds the weights; a larger table is refused.
MAX_WEIGHT_BYTES = 512 << 20
EPSILON = 1e-5

Weights = dict[str, np.ndarray]


def load_weights(table: DataFrame) -> Weights:
    """Matrices by name from rows (name, i, v): row i of matrix name; a vector is a matrix of one row."""
    size = table.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"] * 8
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of weights, at most {MAX_WEIGHT_BYTES} are shipped")
    held: dict[str, list] = {}
    for r in table.orderBy("name", "i").collect():
        rows = held.setdefault(r["name"], [])
        if r["i"] != len(rows) or (rows and len(rows[0]) != len(r["v"])):
            raise ValueError(f"rows of {r['name']} must be numbered from 0 and of one width")
        rows.append(r["v"])
    return {name: np.array(rows, float) for name, rows in held.items()}


# --- layers: (weights, name, x) to a matrix -----------------------------------------------


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0),
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "sigmoid": lambda x: 0.5 * (1 + np.tanh(x / 2)),
    "silu": lambda x: x * 0.5 * (1 + np.tanh(x / 2)),
    "tanh": np.tanh,
    "softmax": softmax,
    "none": lambda x: x,
}


def linear(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """x W^T + b; a matrix without a `.bias` has none."""
    out = x @ w[f"{name}.weight"].T
    return out + w[f"{name}.bias"] if f"{name}.bias" in w else out


def perceptron(w: Weights, name: str, x: np.ndarray, activation: str = "relu") -> np.ndarray:
    """A linear layer, then the normalisation that has weights (`.bn` by stored mean and variance, `.ln` by each row's own), then the activation."""
    out = linear(w, name, x)
    if f"{name}.bn.mean" in w:
        out = (out - w[f"{name}.bn.mean"]) / np.sqrt(w[f"{name}.bn.var"] + EPSILON) * w[f"{name}.bn.weight"] + w[f"{name}.bn.bias"]
    elif f"{name}.ln.weight" in w:
        out = (out - out.mean(1, keepdims=True)) / np.sqrt(out.var(1, keepdims=True) + EPSILON) * w[f"{name}.ln.weight"] + w[f"{name}.ln.bias"]
    return ACTIVATIONS[activation](out)


def mlp(w: Weights, name: str, x: np.ndarray, activation: str = "relu", last: str | None = None) -> np.ndarray:
    """Perceptrons name.0, name.1, ...; `last` is the activation of the last one, by default the same."""
    n = 0
    while f"{name}.{n}.weight" in w:
        n += 1
    if not n:
        raise KeyError(f"{name}.0.weight")
    for i in range(n):
        x = perceptron(w, f"{name}.{i}", x, activation if i + 1 < n or last is None else last)
    return x


def cross(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """Cross layers of rank one: x_l = x_0 (x_(l-1) . w) + b + x_(l-1)."""
    out, i = x, 0
    while f"{name}.{i}.weight" in w:
        out = x * (out @ w[f"{name}.{i}.weight"].T) + w[f"{name}.{i}.bias"] + out
        i += 1
    return out


def low_rank_cross(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """Cross layers through a narrow matrix: x_l = x_0 * (V U x_(l-1) + b) + x_(l-1)."""
    out, i = x, 0
    while f"{name}.{i}.u.weight" in w:
        out = x * linear(w, f"{name}.{i}.v", linear(w, f"{name}.{i}.u", out)) + out
        i += 1
    return out


def interactions(x: np.ndarray, fields: int) -> np.ndarray:
    """Inner products of all pairs of a row's fields, each of an equal part of its columns, by first then second field."""
    parts = x.reshape(len(x), fields, -1)
    a, b = np.triu_indices(fields, 1)
    return np.einsum("npd,npd->np", parts[:, a], parts[:, b])


def factorisation(x: np.ndarray, fields: int) -> np.ndarray:
    """Pairwise products of a row's fields summed up, element by element: half of square of sum less sum of squares."""
    parts = x.reshape(len(x), fields, -1)
    return (parts.sum(1) ** 2 - (parts**2).sum(1)) / 2


def field_gates(w: Weights, name: str, x: np.ndarray, widths: list[int]) -> np.ndarray:
    """Fields times a gate each, which two layers make of all fields' means."""
    edges = np.r_[0, np.cumsum(widths)[:-1]]
    means = np.add.reduceat(x, edges, axis=1) / np.array(widths)
    gates = perceptron(w, f"{name}.1", perceptron(w, f"{name}.0", means, "relu"), "sigmoid")
    return x * np.repeat(gates, widths, axis=1)


def experts(w: Weights, name: str, x: np.ndarray, activation: str = "relu") -> list[np.ndarray]:
    """A mixture of experts name.expert.e for each task t: gates are the softmax of name.gate.t, behind name.gate_mlp.t where that is given."""
    found = []
    while f"{name}.expert.{len(found)}.0.weight" in w:
        found.append(mlp(w, f"{name}.expert.{len(found)}", x, activation))
    every, out = np.stack(found, 1), []
    while f"{name}.gate.{len(out)}.weight" in w:
        t = len(out)
        before = mlp(w, f"{name}.gate_mlp.{t}", x, activation) if f"{name}.gate_mlp.{t}.0.weight" in w else x
        out.append(np.einsum("ne,ned->nd", softmax(linear(w, f"{name}.gate.{t}", before)), every))
    return out


# --- models -------------------------------------------------------------------------------


def _step(w: Weights, s: dict, held: dict[str, np.ndarray]) -> np.ndarray | list[np.ndarray]:
    x = np.hstack([held[n] for n in s["in"]]) if isinstance(s["in"], list) else held[s["in"]]
    op, name, act = s["op"], s.get("name", ""), s.get("activation", "relu")
    if op == "mlp":
        return mlp(w, name, x, act, s.get("last"))
    if op == "linear":
        return ACTIVATIONS[s.get("activation", "none")](linear(w, name, x))
    if op == "cross":
        return cross(w, name, x)
    if op == "low_rank_cross":
        return low_rank_cross(w, name, x)
    if op == "interactions":
        return interactions(x, s["fields"])
    if op == "factorisation":
        return factorisation(x, s["fields"])
    if op == "field_gates":
        return field_gates(w, name, x, s["widths"])
    if op == "experts":
        return experts(w, name, x, act)
    if op == "activation":
        return ACTIVATIONS[act](x)
    if op == "unit":
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if op == "dot":
        return (held[s["in"]] * held[s["with"]]).sum(1, keepdims=True)
    if op == "concat":
        return x
    raise ValueError(f"unknown step {op!r}")


def run_model(weights: Weights, steps: list[dict], columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All matrices of a model: its inputs and what each step gives as `out`, a list of names where it gives several.

    A step is {"op", "in", "out"} with "name" for its weights; "in" is a name, or
    a list of names put side by side.
    """
    held = dict(columns)
    for s in steps:
        found = _step(weights, s, held)
        held.update(zip(s["out"], found) if isinstance(found, list) else {s["out"]: found})
    return held


def score(df: DataFrame, steps: list[dict], weights: Weights, outputs: list[str], reserved: list[str] = ()) -> DataFrame:
    """Reserved columns and outputs in sorted order: a number where the matrix has one column, else an array.

    Inputs are the columns that steps name and no step gives: numbers, or arrays
    of one width; a null number or element counts as 0.  An empty table gives an
    empty one.
    """
    given = {n for s in steps for n in (s["out"] if isinstance(s["out"], list) else [s["out"]])}
    asked = [n for s in steps for n in ([*(s["in"] if isinstance(s["in"], list) else [s["in"]]), *([s["with"]] if "with" in s else [])])]
    inputs = [n for n in dict.fromkeys(asked) if n not in given]
    widths = _widths(df, inputs, steps, weights, outputs)
    names = sorted(outputs)
    fields = [T.StructField(n, T.DoubleType() if widths[n] == 1 else T.ArrayType(T.DoubleType())) for n in names]
    schema = T.StructType([*[df.schema[c] for c in reserved], *fields])
    shipped = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = run_model(shipped.value, steps, {c: matrix_of(batch.column(c), 0.0) for c in inputs})
            out = [pa.array(held[n][:, 0]) if widths[n] == 1 else pa.FixedSizeListArray.from_arrays(pa.array(held[n].ravel()), widths[n]).cast(pa.list_(pa.float64())) for n in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in reserved], *out], names=[*reserved, *names])

    return df.select(*dict.fromkeys([*reserved, *inputs])).mapInArrow(run, schema)


def _widths(df: DataFrame, inputs: list[str], steps: list[dict], weights: Weights, outputs: list[str]) -> dict[str, int]:
    """Columns of each output, from one row of zeros as wide as the first row's inputs."""
    lists = [c for c in inputs if isinstance(df.schema[c].dataType, T.ArrayType)]
    first = df.select(*[F.size(c).alias(c) for c in lists]).first() if lists else None
    if lists and first is None:
        return {n: 1 for n in outputs}
    held = run_model(weights, steps, {c: np.zeros((1, first[c] if c in lists else 1)) for c in inputs})
    return {n: held[n].shape[1] for n in outputs}
