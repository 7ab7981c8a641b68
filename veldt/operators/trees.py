"""Item trees: building from categories or clusters, exports, and beam search.

Nodes are numbered as in a heap: the root is 0 and the children of c are
branches * c + 1 to branches * c + branches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import small_side, stored
from .ordering import placed_in_order, ranked_within
from .sampling import ancestors, parent


def split_code(place: Column, total: Column, branches: int, depth: int) -> Column:
    """Leaf code at `depth` of the item at `place` (from 0) of `total` sorted items: each node's range is split in equal parts.

    Part i of a range of n starts at floor(i n / branches); empty parts get no
    node.  The descent is `depth` steps of arithmetic on each row.
    """
    state = F.struct(F.lit(0).cast("bigint").alias("low"), total.cast("bigint").alias("high"), F.lit(0).cast("bigint").alias("code"))

    def down(s: Column, _: Column) -> Column:
        n, at = s["high"] - s["low"], place - s["low"]
        # the largest i with floor(i n / branches) <= at
        i = F.floor(((at + 1) * branches - 1) / n).cast("bigint")
        return F.struct((s["low"] + F.floor(i * n / branches)).cast("bigint").alias("low"), (s["low"] + F.floor((i + 1) * n / branches)).cast("bigint").alias("high"), (s["code"] * branches + 1 + i).cast("bigint").alias("code"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, down, lambda s: s["code"])


def tree_depth(items: int, branches: int) -> int:
    depth = 0
    while branches**depth < items:
        depth += 1
    return max(1, depth)


def category_tree(items: DataFrame, item_id: str, category: str, branches: int = 2) -> DataFrame:
    """(item_id, tree_code, level): items sorted by category and id, split evenly level by level."""
    n = items.count()
    depth = tree_depth(n, branches)
    placed = placed_in_order(items.select(F.col(item_id).alias("item_id"), F.col(category).alias("__c")), ["__c", "item_id"], "__p")
    return placed.select("item_id", split_code(F.col("__p"), F.lit(n), branches, depth).alias("tree_code"), F.lit(depth).alias("level"))


def balanced_kmeans(vectors: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Labels of k clusters of equal size (to one): k-means, then nearest-first filling up to the cap."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(n, min(k, n), replace=False)]
    for _ in range(rounds):
        d = ((vectors[:, None, :] - centres[None]) ** 2).sum(2)
        label = d.argmin(1)
        new = np.stack([vectors[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    d = ((vectors[:, None, :] - centres[None]) ** 2).sum(2)
    room = np.full(len(centres), n // len(centres))
    room[: n - room.sum()] += 1
    label = np.full(n, -1)
    for at in np.argsort(d, axis=None, kind="stable"):
        i, c = divmod(int(at), len(centres))
        if label[i] < 0 and room[c]:
            label[i] = c
            room[c] -= 1
    return label


def _split_level(nodes: DataFrame, branches: int, rounds: int) -> DataFrame:
    """Rows (item_id, v, code) one level down: k-means within each node over the whole table, then equal parts by nearness."""
    width = len(nodes.first()["v"])
    h = F.xxhash64("item_id")
    centres = nodes.groupBy("code").agg(F.array(*[F.min(F.when(F.pmod(h, F.lit(branches)) == k, F.struct(h.alias("h"), "v")))["v"] for k in range(branches)]).alias("centres"))
    distance = lambda c: F.coalesce(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x), F.lit(float("inf")))
    sizes = stored(nodes.groupBy("code").agg(F.count("*").alias("size")))
    n = sizes.count()
    near_centres = lambda: small_side(centres, n, 8 * branches * width)
    for _ in range(rounds):
        near = nodes.join(near_centres(), "code").withColumn("d", F.transform("centres", distance))
        own = near.withColumn("k", F.array_position("d", F.array_min("d")))
        means = own.groupBy("code", "k").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(width)]).alias("mean"))
        found = means.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", "mean"))).alias("m"))
        centres = stored(centres.join(found, "code").select("code", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("m", i.cast("bigint") + 1), c)).alias("centres")))
    rest = stored(nodes.join(near_centres(), "code").select("item_id", "v", "code", F.transform("centres", distance).alias("d")))
    parts = []
    for k in range(branches):
        if k + 1 < branches:
            # those come first that would lose most by going to one of the parts still to be filled
            gain = F.col("d")[k] - F.array_min(F.slice("d", k + 2, branches))
            ranked = ranked_within(rest.withColumn("gain", F.coalesce(F.nanvl(gain, F.lit(0.0)), F.lit(0.0))), "code", "gain", "item_id", "place").drop("gain")
            quota = F.floor((k + 1) * F.col("size") / branches) - F.floor(k * F.col("size") / branches)
            ranked = stored(ranked.join(small_side(sizes, n, 16), "code").withColumn("in", F.col("place") < quota).drop("place", "size"))
            parts.append(ranked.where("in").drop("in").withColumn("k", F.lit(k)))
            rest = ranked.where("not in").drop("in")
        else:
            parts.append(rest.withColumn("k", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out.select("item_id", "v", (F.col("code") * branches + 1 + F.col("k")).cast("bigint").alias("code")))


def cluster_tree(items: DataFrame, item_id: str, vector: str, branches: int = 2, limit: int = 20_000, seed: int = 0, rounds: int = 5) -> DataFrame:
    """(item_id, tree_code, level): balanced clusters within clusters, each item a leaf of its own.

    Every level is balanced k-means.  While a node has more than `limit` items,
    a level's nodes are split together over the whole table; below, each node's
    items fit in one task, which splits them to the end.
    """
    n = items.count()
    depth = tree_depth(n, branches)
    nodes = items.select(F.col(item_id).alias("item_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.lit(0).cast("bigint").alias("code"))
    coarse = 0
    while n / branches**coarse > limit:
        coarse += 1
    for _ in range(coarse):
        nodes = _split_level(nodes, branches, rounds)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", kind="stable")
        v, codes = np.stack(rows["v"].to_numpy()), np.full(len(rows), rows["code"].iloc[0], np.int64)
        for level in range(depth - coarse):
            new = np.empty_like(codes)
            for c in np.unique(codes):
                own = np.flatnonzero(codes == c)
                part = balanced_kmeans(v[own], min(branches, len(own)), seed=seed + level) if len(own) > 1 else np.zeros(1, int)
                new[own] = codes[own] * branches + 1 + part
            codes = new
        return pd.DataFrame({"item_id": rows["item_id"], "tree_code": codes, "level": depth})

    kind = items.schema[item_id].dataType.simpleString()
    return nodes.groupBy("code").applyInPandas(split, f"item_id {kind}, tree_code long, level int")


def level_of(code: Column, branches: int) -> Column:
    """The level of a node, the root's being 0: how many levels begin at or before its code, in whole numbers."""
    if branches < 2:
        return code.cast("int")
    first, firsts = 1, []
    while first < 1 << 63:
        firsts.append(first)
        first = first * branches + 1
    # bound as a lambda's argument, so that an expression behind the code is worked out once
    begun = F.transform(F.array(code.cast("bigint")), lambda c: F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in firsts]), lambda x: x <= c)))
    return begun[0].cast("int")


def build_tree(leaves: DataFrame, branches: int = 2, attributes: list[str] = (), raw_attributes: list[str] = ()) -> DataFrame:
    """(tree_code, item_id, level, is_leaf, attributes...): leaves and all their ancestors.

    `leaves` has (item_id, tree_code[, attributes]).  Leaves above the last
    level are pushed down to it along first children.  An ancestor is numbered
    after the largest item id, has the most frequent value of each attribute
    (empty ones left out, the smallest of equals) and the mean of each raw one.
    The nodes are stored: exports and searches read them many times.
    """
    code_level = lambda c: level_of(c, branches)
    extra = [*attributes, *raw_attributes]
    rows = leaves.select("item_id", F.col("tree_code").cast("bigint").alias("tree_code"), *extra).withColumn("level", code_level(F.col("tree_code")))
    head = rows.agg(F.max("level").alias("top"), F.max("item_id").alias("last")).first()
    top, last = head["top"] or 0, head["last"] or 0
    down = F.aggregate(F.sequence(F.lit(1), F.lit(top) - F.col("level")), F.col("tree_code"), lambda c, _: c * branches + 1)
    rows = stored(rows.withColumn("tree_code", F.when(F.col("level") < top, down).otherwise(F.col("tree_code"))).withColumn("level", F.lit(top)))
    up = rows.select(F.explode(ancestors(F.col("tree_code"), branches)).alias("code"), *extra)
    inner = up.groupBy("code").agg(F.count("*").alias("n_leaves"), *[F.avg(a).alias(a) for a in raw_attributes])
    for a in attributes:
        counts = up.where(F.col(a).isNotNull() & (F.col(a).cast("string") != "")).groupBy("code", a).agg(F.count("*").alias("n"))
        best = counts.groupBy("code").agg(F.min_by(a, F.struct(-F.col("n"), a)).alias(a))
        inner = inner.join(best, "code", "left")
    for a in raw_attributes:
        if dict(leaves.dtypes)[a] in ("int", "bigint"):
            inner = inner.withColumn(a, F.round(a).cast(dict(leaves.dtypes)[a]))
    nodes = inner.select(F.col("code").alias("tree_code"), (F.lit(last) + F.col("code") + 1).alias("item_id"), code_level(F.col("code")).alias("level"), F.lit(False).alias("is_leaf"), *extra)
    return stored(nodes.unionByName(rows.select("tree_code", F.col("item_id").cast("bigint").alias("item_id"), "level", F.lit(True).alias("is_leaf"), *extra)))


def tree_edges(nodes: DataFrame, branches: int) -> DataFrame:
    """(src_id, dst_id, weight): each leaf to its ancestors, the root left out."""
    up = nodes.where("is_leaf").select(F.col("item_id").alias("src_id"), F.explode(ancestors(F.col("tree_code"), branches)).alias("code")).where("code > 0")
    return up.join(nodes.select(F.col("tree_code").alias("code"), F.col("item_id").alias("dst_id")), "code").select("src_id", "dst_id", F.lit(1.0).alias("weight"))


def predict_edges(nodes: DataFrame, branches: int) -> DataFrame:
    """(src_id, dst_id, weight): each node to its children."""
    child = nodes.where("tree_code > 0").select(F.col("item_id").alias("dst_id"), parent(F.col("tree_code"), branches).alias("code"))
    return child.join(nodes.select(F.col("tree_code").alias("code"), F.col("item_id").alias("src_id")), "code").select("src_id", "dst_id", F.lit(1.0).alias("weight"))


def node_table(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """(id, weight, attrs): joined attributes in level order, with a root row of id -1."""
    rows = nodes.select(F.col("item_id").alias("id"), F.lit(1.0).alias("weight"), F.concat_ws(":", F.col("level").cast("string"), *[F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes]).alias("attrs"), "level", "tree_code")
    root = nodes.where("tree_code = 0").select(F.lit(-1).cast("bigint").alias("id"), F.lit(1.0).alias("weight"), F.lit("").alias("attrs"), F.lit(-1).alias("level"), F.lit(-1).cast("bigint").alias("tree_code"))
    return root.unionByName(rows).orderBy("level", "tree_code").select("id", "weight", "attrs")


def serving_tree(nodes: DataFrame) -> DataFrame:
    """(tree_code, item_id, is_leaf) in level order."""
    return nodes.orderBy("level", "tree_code").select("tree_code", "item_id", "is_leaf")


def start_level(branches: int, k: int, top: int) -> int:
    """The first level with 2 k branches nodes, at most the last."""
    return min(top, math.ceil(math.log(2 * branches * k, branches)))


def beam_search(queries: DataFrame, nodes: DataFrame, k: int, branches: int, score: Callable[[DataFrame], Column | DataFrame], query_id: str = "query_id") -> DataFrame:
    """(query_id, item_id, score, rank): from a start level down, the 2 k best nodes stay; leaves give the k best items.

    `score` maps a table of queries joined with nodes to a number, or to the
    table with a column `score`, as models do.  Levels are joined by the parent's
    code, so only children of kept nodes are scored.
    """
    top = nodes.agg(F.max("level").alias("m")).first()["m"] or 0
    level = start_level(branches, k, top)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "tree_code")
    first = nodes.where(F.col("level") == level)
    # every query meets the start level: at most branches times 2 k branches nodes
    table = queries.crossJoin(F.broadcast(first))
    while True:
        found = score(table)
        scored = (found if isinstance(found, DataFrame) else table.withColumn("score", found)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k)
        if level >= top:
            break
        level += 1
        kept = scored.select(query_id, F.col("tree_code").alias("parent"))
        below = nodes.where(F.col("level") == level).withColumn("parent", parent(F.col("tree_code"), branches))
        table = kept.join(below, "parent").drop("parent").join(queries, query_id)
    leaves = scored.where("is_leaf").groupBy(query_id, "item_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy(query_id).orderBy(F.desc("score"), "item_id")
    return leaves.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def retrieval_recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Share of the true (query, item) rows that were found."""
    hits = truth.select(query_id, "item_id").distinct().join(found.select(query_id, "item_id", F.lit(1.0).alias("h")), [query_id, "item_id"], "left")
    return hits.agg(F.avg(F.coalesce("h", F.lit(0.0))).alias("recall"))
