"""Connected components by stars within tasks, then alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import saved
from .textops import release_memory

#: Edges that a task turns into stars, about, and rows of a batch of these.
FOREST_EDGES, FOREST_ROWS = 100_000, 10_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], int(row["h"])


def _larger_first(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v) of a task's edges as stars: every node with the smallest node that it reaches within the task, itself included."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for x, y in zip(batch["u"].tolist(), batch["v"].tolist()):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), FOREST_ROWS):
        part = nodes[i : i + FOREST_ROWS]
        yield pd.DataFrame({"u": part, "v": [find(x) for x in part]})
    release_memory()


def connected_components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reached.

    Edges may repeat, run in either direction and be loops; `rows` is about how
    many nodes they have, if that is known.  First tasks of about FOREST_EDGES
    turn their edges into stars, over fewer tasks as long as that halves the
    edges: where one task is enough, its stars are the result, which spares the
    driver the many jobs of the rounds.

    Else rounds follow.  Each is two grouped minima joined back to the edges: a
    node with very many edges is summed up before it is shuffled, and the minima
    are stored before the join, so that both sides of it are plain shuffles,
    which adaptive execution splits where one node's edges fill a partition.
    Rounds end when the edges stay the same; each is checkpointed, so lineage
    stays short and a lost executor costs one round at most.  No round has more
    edges than the one before.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = e.select(*_larger_first(F.col("u"), F.col("v"))).distinct()
    if rows is None:
        e = saved(e)
        rows = e.count()
    while True:
        tasks = max(1, -(-rows // FOREST_EDGES))
        e = e.coalesce(tasks).mapInPandas(_forest, e.schema).checkpoint()
        if tasks == 1:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        n = e.count()
        if 2 * n > rows:
            break
        rows = n
    loops = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = saved(e.where("u <> v").distinct(), n)
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * before[0])
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = saved(e, before[0])
        low = saved(e.groupBy("u").agg(F.min("v").alias("m")), before[0])
        moved = e.join(low, "u").where("v <> m").select(*_larger_first(F.col("v"), F.col("m")))
        e = saved(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), before[0])
        after = _state(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    joined = stars.unionByName(centres)
    alone = loops.join(joined, "node", "left_anti").select("node", F.col("node").alias("component"))
    return joined.unionByName(alone)
