"""Several interests of a user from one behaviour sequence, by routing with given projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import uniform


def first_logits(user: str, steps: Column, k: int, deviation: float, seed: int = 0) -> Column:
    """A normal number for each step and interest, by hashes of user, step and interest (Box and Muller), step by step."""
    draw = lambda s, j, n: uniform(F.col(user), s, F.lit(j), F.lit(n), seed=seed)
    normal = lambda s, j: deviation * F.sqrt(-2 * F.ln(draw(s, j, 0))) * F.cos(2 * F.lit(np.pi) * draw(s, j, 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), steps - 1), lambda s: F.array(*[normal(s, j) for j in range(k)])))


def interest_count(steps: np.ndarray, k: int) -> np.ndarray:
    """Interests of sequences of so many steps: the binary logarithm rounded up, between 1 and k."""
    return np.ceil(np.clip(np.log2(np.maximum(steps, 1)), 1, k)).astype(int)


def squash(x: np.ndarray, power: float) -> np.ndarray:
    """Vectors of the last axis shortened to a length below 1, (n^2 / (1 + n^2))^power for a length n."""
    n = np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-7)
    return (n**2 / (1 + n**2)) ** power / n * x


def route(low: np.ndarray, steps: np.ndarray, logits: np.ndarray, active: np.ndarray, rounds: int, scale: float, power: float) -> np.ndarray:
    """(users, k, width) interests of projected sequences (users, steps, width), padded beyond each one's steps.

    Each round assigns every step to the interests by softmax of its logits and
    sums the steps up by these shares; the next logits are the shares and the
    agreement of the sums with the steps' directions.
    """
    k = logits.shape[2]
    on = np.arange(low.shape[1])[None, :, None] < steps[:, None, None]
    closed = np.arange(k)[None, None, :] >= active[:, None, None]
    length = np.linalg.norm(low, axis=-1, keepdims=True)
    direction = low / np.maximum(length, 1e-12)
    for r in range(rounds):
        x = np.where(closed, -np.inf, logits * scale)
        e = np.exp(x - x.max(2, keepdims=True))
        share = np.where(on, e / e.sum(2, keepdims=True), 0.0)
        high = np.einsum("bsh,bsk->bkh", low, share)
        if r + 1 < rounds:
            logits = share + np.einsum("bkh,bsh->bsk", high, direction)
    return squash(high, power)


def routed_interests(
    users: DataFrame, sequence: str, projection: np.ndarray, k: int, rounds: int = 3, max_steps: int = 64, user: str = "user_id",
    scale: float = 1.0, deviation: float = 1.0, power: float = 1.0, constant: bool = False, seed: int = 0,
) -> DataFrame:
    """(user, interest, embedding): k interests of a user at most, numbered from 0, of an array of item vectors in order.

    The first `max_steps` steps count.  A short sequence has fewer interests
    (see interest_count), unless they are `constant`; an empty or null one has
    none.  The first logits are hashes, so a lost task gives the same interests
    again.  A step must be as wide as the projection is high.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    projection = np.asarray(projection, float)
    steps = F.slice(F.transform(sequence, lambda v: F.transform(v, lambda x: x.cast("double"))), 1, max_steps)
    rows = users.select(F.col(user), steps.alias("__s")).where(F.size("__s") > 0)
    rows = rows.withColumn("__l", first_logits(user, F.size("__s"), k, deviation, seed))
    schema = T.StructType([users.schema[user], T.StructField("interest", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                seq, first = part.column("__s"), part.column("__l")
                n = np.diff(seq.offsets.to_numpy())
                flat = seq.flatten()
                width = np.unique(np.diff(flat.offsets.to_numpy()))
                if width.tolist() != [len(projection)] or flat.flatten().null_count:
                    raise ValueError(f"steps must have {len(projection)} numbers")
                at = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(x) for x in n])
                low, logits = np.zeros((len(n), n.max(), projection.shape[1])), np.zeros((len(n), n.max(), k))
                low[at] = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(projection)) @ projection
                logits[at] = first.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                active = np.full(len(n), k) if constant else interest_count(n, k)
                out = route(low, n, logits, active, rounds, scale, power)
                row, number = np.nonzero(np.arange(k)[None] < active[:, None])
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(out[row, number].ravel()), out.shape[2]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), vectors], names=schema.names)

    return rows.mapInArrow(run, schema)


def interest_queries(interests: DataFrame, user: str = "user_id") -> DataFrame:
    """(query_id, user, embedding): each interest as a query of its own, to be merged by user after retrieval."""
    return interests.select(F.concat_ws("/", F.col(user).cast("string"), "interest").alias("query_id"), user, "embedding")
