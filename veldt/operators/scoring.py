"""Scoring with a given model, and reports of metrics as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predict(df: DataFrame, model: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: dict[str, T.DataType], reserved: list[str] = ()) -> DataFrame:
    """Reserved columns and a model's outputs, in sorted order; the model gets and gives one array per column of a batch.

    Only inputs and reserved columns leave the scan.  List columns come as
    arrays of lists.
    """
    names = sorted(outputs)
    schema = T.StructType([*[df.schema[c] for c in reserved], *[T.StructField(n, outputs[n]) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model({c: batch[c].to_numpy() for c in inputs})
            yield pd.concat([batch[list(reserved)], pd.DataFrame({n: list(found[n]) for n in names}, index=batch.index)], axis=1)

    return df.select(*dict.fromkeys([*reserved, *inputs])).mapInPandas(run, schema)


def regrouped(df: DataFrame, request: str, order: str, outputs: list[str]) -> DataFrame:
    """Outputs of a request's rows as one list each, in order: what flattening took apart."""
    rows = df.groupBy(request).agg(F.sort_array(F.collect_list(F.struct(order, *outputs))).alias("l"))
    return rows.select(request, *[F.col("l")[c].alias(c) for c in outputs])


def linear_model(weights: dict[str, float], bias: float = 0.0) -> Callable:
    """A logistic model of number columns, as an example and for tests."""

    def score(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        logits = sum((columns[c].astype(float) * w for c, w in weights.items()), np.float64(bias))
        return {"logits": logits, "probs": 1 / (1 + np.exp(-logits))}

    return score


def report_line(metrics: DataFrame, global_step: int) -> str:
    """One row of metrics as a JSON line, names sorted after the step."""
    row = metrics.first().asDict()
    return json.dumps({"global_step": global_step} | {k: row[k] for k in sorted(row)})
