"""Semantic ids: residual quantising, quality reports, collision resolution and appending."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import doubles
from ..sources.session import stored

HASH_SEED = 2026


# --- codes ----------------------------------------------------------------------------


def codebook_columns(books: list[list[list[float]]]) -> list[Column]:
    return [F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in book]) for book in books]


def quantise(items: DataFrame, books: list[list[list[float]]], vector: str = "embedding", normalise: bool = False, candidates: int = 0) -> DataFrame:
    """Add `codes`: layer by layer the nearest centroid, which is then taken away; equal distances take the lower code.

    With `candidates` also add `candidate_codes`: all layers' codes with each of
    the last layer's so many nearest centroids.  Codebooks are model parameters
    of bounded size and part of the plan.
    """
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    df = items.withColumn("__r", doubles(F.col(vector)))
    if normalise:
        df = df.withColumn("__r", F.transform("__r", lambda x: F.coalesce(F.try_divide(x, F.sqrt(square(F.col("__r")))), F.lit(0.0))))
    codes = []
    for n, book in enumerate(codebook_columns(books)):
        ranked = F.transform(book, lambda c, i: F.struct(square(minus(F.col("__r"), c)).alias("d"), i.alias("i")))
        last = n == len(books) - 1
        df = df.withColumn(f"__k{n}", F.slice(F.array_sort(ranked), 1, max(1, candidates if last else 1)))
        df = df.withColumn(f"__c{n}", F.col(f"__k{n}")[0]["i"]).withColumn("__r", minus(F.col("__r"), book[F.col(f"__c{n}")]))
        codes.append(F.col(f"__c{n}"))
    df = df.withColumn("codes", F.array(*codes))
    if candidates:
        df = df.withColumn("candidate_codes", F.transform(f"__k{len(books) - 1}", lambda s: F.concat(F.slice("codes", 1, len(books) - 1), F.array(s["i"]))))
    return df.drop("__r", *[f"__{p}{n}" for p in "kc" for n in range(len(books))])


def decode(codes: Column, books: list[list[list[float]]]) -> Column:
    """The sum of the layers' centroids."""
    parts = [book[F.get(codes, F.lit(n))] for n, book in enumerate(codebook_columns(books))]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def fit_codebooks(items: DataFrame, sizes: list[int], vector: str = "embedding", seed: int = 0) -> list[list[list[float]]]:
    """One k-means (MLlib, distributed) per layer, on what the layers before leave."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = items.count()
    books: list[list[list[float]]] = []
    for size in sizes:
        if n < size:
            raise ValueError(f"{n} items are fewer than {size} codes")
        left = items.withColumn("__v", doubles(F.col(vector)))
        if books:
            left = quantise(items, books, vector).withColumn("__v", F.zip_with(doubles(F.col(vector)), decode(F.col("codes"), books), lambda x, y: x - y))
        model = KMeans(k=size, seed=seed, featuresCol="__f").fit(left.select(array_to_vector("__v").alias("__f")))
        centres = [c.tolist() for c in model.clusterCenters()]
        books.append(centres + [centres[-1]] * (size - len(centres)))
    return books


def mixed_radix(codes: Column, sizes: list[int]) -> Column:
    """One number of all codes, the first layer most significant."""
    radix = [math.prod(sizes[i + 1 :]) for i in range(len(sizes))]
    return sum((F.get(codes, F.lit(i)).cast("bigint") * r for i, r in enumerate(radix)), F.lit(0).cast("bigint"))


def from_radix(key: Column, sizes: list[int]) -> Column:
    return F.array(*[(F.floor(key / math.prod(sizes[i + 1 :])) % s).cast("int") for i, s in enumerate(sizes)])


def offset_codes(codes: Column, sizes: list[int]) -> Column:
    """Codes shifted so that layers share one numbering."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    return F.transform(codes, lambda c, i: c + F.array(*[F.lit(s) for s in starts])[i])


def valid_codes(codes: Column, sizes: list[int]) -> Column:
    """Whether every layer has a code in range."""
    limits = F.array(*[F.lit(s) for s in sizes])
    return F.coalesce((F.size(codes) == len(sizes)) & F.forall(F.zip_with(codes, limits, lambda c, s: c.isNotNull() & (c >= 0) & (c < s)), lambda ok: ok), F.lit(False))


def require_valid(df: DataFrame, codes: str, sizes: list[int], drop: bool = False) -> DataFrame:
    """Only valid rows; an invalid one is an error unless `drop`."""
    ok = valid_codes(F.col(codes), sizes)
    if drop:
        return df.where(ok)
    return df.withColumn(codes, F.when(ok, F.col(codes)).otherwise(F.raise_error(F.concat(F.lit("invalid codes "), F.coalesce(F.to_json(codes), F.lit("null"))))))


# --- quality --------------------------------------------------------------------------


def quality(df: DataFrame, codes: str, sizes: list[int]) -> DataFrame:
    """One row: total, unique, rates, largest bucket, gini and entropy (nats) of the buckets in use.

    Gini and entropy need only how many buckets have each size, which is a small
    table even where buckets are many.
    """
    buckets = df.groupBy(mixed_radix(F.col(codes), sizes).alias("k")).agg(F.count("*").alias("c"))
    sizes_of = buckets.groupBy("c").agg(F.count("*").cast("double").alias("m"))
    w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes_of.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0.0)))
    total = F.sum(F.col("c") * F.col("m"))
    unique = F.sum("m")
    # over buckets in rising order, sum of (2 i - n - 1) x_i / (n sum x)
    rank_sum = F.sum(F.col("c") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2))
    one = ranked.agg(
        total.cast("long").alias("total"), unique.cast("long").alias("unique_sids"), F.sum(F.when(F.col("c") == 1, F.col("m")).otherwise(0.0)).alias("single"),
        F.max("c").alias("max_bucket"), rank_sum.alias("rs"), F.sum(F.col("m") * F.col("c") * F.ln(F.col("c").cast("double"))).alias("clc"),
    )
    n, t = F.col("unique_sids").cast("double"), F.col("total").cast("double")
    entropy = F.ln(t) - F.try_divide("clc", t)
    top = sum(math.log(s) for s in sizes)
    return one.select(
        "total", "unique_sids", F.try_divide(n, t).alias("no_collision_rate"), F.try_divide("single", n).alias("singleton_rate"), "max_bucket",
        F.try_divide(2 * F.col("rs") - (n + 1) * t, n * t).alias("gini"), entropy.alias("entropy"), F.lit(top).alias("max_entropy"), (entropy / top).alias("entropy_ratio"),
    )


def layer_quality(df: DataFrame, codes: str, sizes: list[int]) -> DataFrame:
    """(layer, coverage, dead_codes, perplexity) of each layer."""
    table = F.array(*[F.lit(s) for s in sizes])
    counts = df.select(F.posexplode(codes).alias("layer", "code")).groupBy("layer", "code").agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy("layer").agg(F.count("*").alias("used"), F.sum("c").alias("t"), F.sum(F.col("c") * F.ln("c")).alias("clc"))
    size = table[F.col("layer")]
    return per.select("layer", (F.col("used") / size).alias("coverage"), (size - F.col("used")).cast("long").alias("dead_codes"), F.exp(F.ln("t") - F.col("clc") / F.col("t")).alias("perplexity"))


def top_buckets(df: DataFrame, codes: str, sizes: list[int], n: int) -> DataFrame:
    """(sid_key, codes, count): the fullest buckets, equal ones by key."""
    key = mixed_radix(F.col(codes), sizes)
    counts = df.groupBy(key.alias("sid_key")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "sid_key").limit(n).withColumn("codes", from_radix(F.col("sid_key"), sizes))


def quality_report(df: DataFrame, before: str, sizes: list[int], after: str | None = None) -> DataFrame:
    """(view, metric, value) of one set of codes, or of both and their difference over rows valid in both."""

    def long(column: str, view: str, rows: DataFrame) -> DataFrame:
        q = quality(rows, column, sizes)
        return q.select(F.lit(view).alias("view"), F.explode(F.create_map(*[x for c in q.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))

    if after is None:
        return long(before, "single", df.where(valid_codes(F.col(before), sizes)))
    both = df.where(valid_codes(F.col(before), sizes) & valid_codes(F.col(after), sizes))
    a, b = long(before, "before", both), long(after, "after", both)
    delta = a.alias("a").join(b.alias("b"), F.col("a.metric") == F.col("b.metric")).select(F.lit("delta").alias("view"), F.col("a.metric").alias("metric"), (F.col("b.value") - F.col("a.value")).alias("value"))
    return a.unionByName(b).unionByName(delta)


# --- collisions -----------------------------------------------------------------------


# Fixed values of SplitMix64 and the seed that makes hashes agree with published semantic ids.
SPLITMIX_STEP = 0x9E3779B97F4A7C15
SPLITMIX_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SIGN = 1 << 63


def splitmix(x: np.ndarray, seed: int = HASH_SEED) -> np.ndarray:
    """SplitMix64 of uint64 numbers with a seed, stable over machines; wraps around on purpose."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(seed * SPLITMIX_STEP & (1 << 64) - 1)
        for shift, factor in zip((30, 27), SPLITMIX_FACTORS):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return z ^ (z >> np.uint64(31))


def with_hash(df: DataFrame, item_id: str, out: str = "item_hash") -> DataFrame:
    """Add a stable hash of the item id: 64 bits, the sign flipped so that signed order is unsigned order.

    Text ids go through pandas' own stable hash first.
    """

    @F.pandas_udf("long")
    def h(ids: pd.Series) -> pd.Series:
        base = ids.to_numpy(np.int64).view(np.uint64) if ids.dtype.kind in "iu" else pd.util.hash_array(ids.to_numpy(object))
        return pd.Series((splitmix(base) ^ np.uint64(SIGN)).view(np.int64))

    return df.withColumn(out, h(F.col(item_id)))


def _band(codes: Column, sizes: list[int]) -> Column:
    return mixed_radix(F.slice(codes, 1, len(sizes) - 1), sizes[:-1]) if len(sizes) > 1 else F.lit(0).cast("bigint")


def collision_plan(items: DataFrame, codes: str, sizes: list[int], capacity: int, hash_col: str, prior: DataFrame | None = None) -> DataFrame:
    """Add band (all layers but the last), last, key, rank in the bucket by hash, and overflow where rank reaches the room left.

    `prior` has (key, n): places of a bucket that published items hold.
    """
    df = items.withColumn("band", _band(F.col(codes), sizes)).withColumn("last", F.get(F.col(codes), F.lit(len(sizes) - 1))).withColumn("key", mixed_radix(F.col(codes), sizes))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(hash_col, "item_id")) - 1)
    if prior is not None:
        df = df.join(prior.select("key", F.col("n").alias("taken")), "key", "left")
    else:
        df = df.withColumn("taken", F.lit(0))
    return df.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("overflow", F.col("rank") + F.col("taken") >= capacity)


#: Overflowing items of a band that one task places.
HOT_BAND = 200_000


def _proposals(over: DataFrame, counts: DataFrame, capacity: int, last_size: int, draws: int) -> DataFrame:
    """(item_id, resolved_last) of overflowing items (item_id, band, last, h, choice), by rounds of proposals.

    Every item proposes to the first of its choices that has not refused it; a
    code keeps as many as it has room for, the first by (last code, hash, id),
    and refuses the others.  All codes rank alike, so what is left when no code
    refuses is what placing the items one by one in that order gives.
    """
    @F.pandas_udf("array<int>")
    def drawn(hashes: pd.Series) -> pd.Series:
        return pd.Series([drawn_codes(int(h), last_size, draws) for h in hashes])

    choice = F.when(F.size("choice") > 0, F.col("choice")).otherwise(drawn("h"))
    state = over.withColumn("choice", choice).withColumn("choice", F.filter("choice", lambda c: c != F.col("last"))).withColumn("at", F.lit(0))
    # codes without room are left out from the start; the window below then keeps `capacity` rows of a code before it is shuffled
    room = stored(counts.select("band", F.col("last").alias("to"), (F.lit(capacity) - F.col("n")).alias("room")))
    state = stored(state)
    order = Window.partitionBy("band", "to").orderBy("last", "h", "item_id")
    while True:
        asking = state.where(F.col("at") < F.size("choice")).withColumn("to", F.get("choice", F.col("at")))
        first = asking.select("item_id", "band", "to", "last", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= capacity)
        kept = first.join(room, ["band", "to"], "left").where(F.col("r") <= F.coalesce("room", F.lit(capacity))).select("item_id", F.lit(True).alias("kept"))
        told = stored(state.join(kept, "item_id", "left").withColumn("refused", F.col("kept").isNull() & (F.col("at") < F.size("choice"))).drop("kept"))
        if told.where("refused").first() is None:
            return told.select("item_id", F.coalesce(F.get("choice", F.col("at")), F.col("last")).cast("int").alias("resolved_last"))
        state = told.withColumn("at", F.col("at") + F.col("refused").cast("int")).drop("refused")


def resolve_collisions(
    items: DataFrame, codes: str, sizes: list[int], capacity: int, hash_col: str = "item_hash", candidates: str | None = None, draws: int = 0, prior: DataFrame | None = None,
    hot_band: int | None = None,
) -> DataFrame:
    """(item_id, codes, resolved_last, slot, moved): items beyond a bucket's capacity move to another last code of their band.

    Overflowing items go in order of (last code, hash) and take the first
    candidate with room, their own code left out; without one they stay, over
    capacity.  Candidates are a column of code lists, or `draws` last codes drawn
    by hash, with replacement.  Bands are independent, so each is one group; a task
    sees a band's overflow and its counts only, the items that fit never move.
    A band with more than `hot_band` overflowing items (HOT_BAND) goes by rounds
    of proposals over all tasks, with the same result.
    """
    last_size = sizes[-1]
    plan = collision_plan(items, codes, sizes, capacity, hash_col, prior).drop("key")
    fits = plan.where("not overflow")
    counts = fits.groupBy("band", "last").agg(F.count("*").alias("n"))
    if prior is not None:
        old = prior.select(F.floor(F.col("key") / last_size).cast("bigint").alias("band"), (F.col("key") % last_size).cast("int").alias("last"), "n")
        bands = plan.where("overflow").select("band").distinct()
        counts = counts.unionByName(old.join(bands, "band", "left_semi")).groupBy("band", "last").agg(F.sum("n").alias("n"))
    over = plan.where("overflow")
    choice = F.transform(candidates, lambda c: F.element_at(c, -1)) if candidates else F.array().cast("array<int>")
    over = over.select("item_id", "band", "last", F.col(hash_col).alias("h"), choice.alias("choice"))

    def first_fit(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        used = dict(zip(held["held_last"], held["n"]))
        rows = rows.sort_values(["last", "h", "item_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            options = r.choice if len(r.choice) else drawn_codes(int(r.h), last_size, draws)
            target = next((int(c) for c in options if int(c) != r.last and used.get(int(c), 0) < capacity), int(r.last))
            used[target] = used.get(target, 0) + 1
            out.append((r.item_id, target))
        return pd.DataFrame(out, columns=["item_id", "resolved_last"])

    kind = items.schema["item_id"].dataType.simpleString()
    # of such bands there are at most overflow / hot_band
    hot = [r["band"] for r in over.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > (hot_band or HOT_BAND)).select("band").collect()]
    counts = stored(counts) if hot else counts
    placed = None
    if hot:
        is_hot = F.broadcast(items.sparkSession.createDataFrame([(b,) for b in hot], "band long"))
        placed = _proposals(over.join(is_hot, "band", "left_semi"), counts, capacity, last_size, draws)
        over = over.join(is_hot, "band", "left_anti")
    counts = counts.select(F.col("band").alias("held_band"), F.col("last").alias("held_last"), "n")
    moved = over.groupBy("band").cogroup(counts.groupBy("held_band")).applyInPandas(first_fit, f"item_id {kind}, resolved_last int")
    moved = moved if placed is None else moved.unionByName(placed)
    done = plan.join(moved, "item_id", "left").withColumn("resolved_last", F.coalesce("resolved_last", "last"))
    # slots count on from published ones: items that fit first, by hash, then the others as they were placed
    w = Window.partitionBy("band", "resolved_last").orderBy("overflow", F.when(F.col("overflow"), F.col("last")), hash_col, "item_id")
    done = done.withColumn("key", F.col("band") * last_size + F.col("resolved_last"))
    if prior is not None:
        done = done.drop("taken").join(prior.select("key", F.col("n").alias("taken")), "key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return done.select(
        "item_id", codes, F.concat(F.slice(codes, 1, len(sizes) - 1), F.array("resolved_last")).alias("resolved_codes"), "resolved_last",
        (F.row_number().over(w) + F.col("taken")).cast("int").alias("slot"), (F.col("resolved_last") != F.col("last")).alias("moved"), "key",
    )


def drawn_codes(h: int, size: int, draws: int) -> list[int]:
    """Last codes drawn from an item's hash, with replacement; at most one less than there are."""
    n = min(draws, size - 1)
    steps = np.arange(n, dtype=np.uint64) * np.uint64(SPLITMIX_STEP)
    with np.errstate(over="ignore"):
        return [int(c) for c in splitmix(np.uint64(h % (1 << 64) ^ SIGN) + steps) % np.uint64(size)]


def group_items(resolved: DataFrame) -> DataFrame:
    """(key, resolved_codes, item_ids): items of each id in slot order."""
    return resolved.groupBy("key").agg(F.first("resolved_codes").alias("resolved_codes"), F.transform(F.sort_array(F.collect_list(F.struct("slot", "item_id"))), lambda s: s["item_id"]).alias("item_ids"))


def append_items(published: DataFrame, new: DataFrame, codes: str, sizes: list[int], capacity: int, hash_col: str = "item_hash", **kw) -> dict[str, DataFrame]:
    """Add items to published ones, which never move.

    `published` has (item_id, key, slot).  Returns `resolved` of the new items,
    `groups` of all and `delta`, the groups that grew.
    """
    fresh = new.join(published.select("item_id"), "item_id", "left_anti")
    prior = published.groupBy("key").agg(F.count("*").alias("n"))
    resolved = resolve_collisions(fresh, codes, sizes, capacity, hash_col, prior=prior, **kw)
    every = published.select("item_id", "key", "slot").unionByName(resolved.select("item_id", "key", "slot"))
    groups = every.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "item_id"))), lambda s: s["item_id"]).alias("item_ids"))
    return {"resolved": resolved, "groups": groups, "delta": groups.join(resolved.select("key").distinct(), "key", "left_semi")}


def align_candidates(items: DataFrame, candidates: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Items with their candidate lists; an item without one is an error."""
    found = items.join(candidates.select(item_id, "candidate_codes").dropDuplicates([item_id]), item_id, "left")
    return found.withColumn("candidate_codes", F.when(F.col("candidate_codes").isNotNull(), F.col("candidate_codes")).otherwise(F.raise_error(F.concat(F.lit("no candidates for item "), F.col(item_id).cast("string")))))
