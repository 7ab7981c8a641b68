"""Samplers that any engine can repeat: randomness is a hash of seed, row and item."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.session import small_side, stored
from .ordering import ranked_within


def uniform(*parts: Column | str | int, seed: int = 0) -> Column:
    """A number in (0, 1) from the md5 of seed and parts."""
    columns = [F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def sample_mask(share: float, *parts: Column | str, seed: int = 0) -> Column:
    """True for about this share of the rows."""
    return uniform(*parts, seed=seed) < share


def weighted_sample(items: DataFrame, n: int, weight: str, *keys: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, by weight: the largest of ln(u) / w stay (Efraimidis and Spirakis)."""
    w = F.col(weight).cast("double")
    return items.where(w > 0).orderBy(F.desc(F.ln(uniform(*keys, seed=seed)) / w), *keys).limit(n)


def expansion(num_sample: int, num_positive: int) -> int:
    """Negatives per positive row, rounded up; a batch of all is cut to `num_sample`."""
    return -(-num_sample // max(1, num_positive))


def weight_intervals(items: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """(item, low, high): items of positive weight end to end on a line, each as long as its weight.

    The order is by four digits of the id's md5, then by id: sums over the
    65,536 groups of a prefix come first, sums within each group after.
    """
    rows = items.select(F.col(item), F.substring(F.md5(F.col(item).cast("string").cast("binary")), 1, 4).alias("__b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).where("__w > 0")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__b").agg(F.sum("__w").alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__base"))
    within = Window.partitionBy("__b").orderBy(item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.col("__base") + F.sum("__w").over(within)
    return rows.join(F.broadcast(base), "__b").select(item, (high - F.col("__w")).alias("low"), high.alias("high"))


def sample_size(num: int, num_eval: int | None = None, training: bool = True) -> int:
    """How many samples to draw: `num_eval`, where it is given, when not training."""
    return num if training or num_eval is None else num_eval


#: Draws of a user in the first round of negatives, as a multiple of the wanted number; each further round has four times as many.
DRAWS, ROUNDS = 3, 4
#: Items with more than this share of all weight are cut out of the line where they may not be drawn; there are at most 1 / HEAVY.
HEAVY = 1 / 64


def negative_sample(
    positives: DataFrame, items: DataFrame, user: str, item: str, num: int, weight: str | None = None, edges: DataFrame | None = None, seed: int = 0,
) -> DataFrame:
    """(user, item, rank): `num` negatives of each user, none a positive of theirs, drawn by weight among all items without replacement.

    Positives are the user's rows of `positives` and, if given, of `edges`.
    Draws are points on the line of all weights; repeats and positives are
    passed over, which is drawing one by one from what is left.  A point finds
    its item by the slot it falls into, of as many equal slots as items, so a
    user meets its draws and never all items.  Positives of much weight are cut
    out of a user's line: a point beyond one moves on by its length.

    Users who come short, because few items have nearly all weight, go on
    without what they have found: its heavy items are cut out, too, and they
    draw as often as the weight that is left to them asks for.  Each of these
    rounds finds an item at least, mostly all.  Only a user whose light
    positives leave so little that this would be more draws than there are items
    ranks the items by ln(u) / w, which is the same distribution.
    """
    line = stored(weight_intervals(items, item, weight))
    head = line.agg(F.count("*").alias("n"), F.max("high").alias("w")).first()
    known = positives.select(user, item)
    if edges is not None:
        known = known.unionByName(edges.select(user, item))
    known = stored(known.distinct())
    users = positives.select(user).distinct()
    n, total = head["n"], head["w"] or 1.0
    if not n:
        return known.withColumn("rank", F.lit(1)).limit(0)
    slot = lambda x: F.least(F.lit(n - 1), F.floor(x / total * n)).cast("bigint")
    slots = stored(line.withColumn("__slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high"))))))
    heavy = F.broadcast(line.where(F.col("high") - F.col("low") > HEAVY * total).select(item, F.struct("low", "high").alias("__cut")))  # 1 / HEAVY rows at most
    any_heavy = line.where(F.col("high") - F.col("low") > HEAVY * total).first() is not None
    none = F.array().cast("array<struct<low:double,high:double>>")

    def with_cuts(who: DataFrame, taken: DataFrame) -> DataFrame:
        """Add the heavy intervals that each user may not draw, in order, and the length of the line without them."""
        if any_heavy:
            cuts = taken.join(heavy, item).groupBy(user).agg(F.sort_array(F.collect_list("__cut")).alias("__cuts"))
            who = who.join(cuts, user, "left").withColumn("__cuts", F.coalesce("__cuts", none))
        else:
            who = who.withColumn("__cuts", none)
        return who.withColumn("__room", F.lit(total) - F.aggregate("__cuts", F.lit(0.0), lambda t, c: t + c["high"] - c["low"]))

    def drawn(who: DataFrame, taken: DataFrame, draws: Column, salt: int) -> DataFrame:
        """(user, item, j): first hits of points on each user's line that are not taken."""
        points = who.withColumn("__j", F.explode(F.sequence(F.lit(1), draws)))
        x = F.aggregate("__cuts", uniform(user, "__j", seed=salt) * F.col("__room"), lambda at, c: F.when(at >= c["low"], at + c["high"] - c["low"]).otherwise(at))
        points = points.select(user, "__j", x.alias("__x")).withColumn("__slot", slot(F.col("__x")))
        hits = points.join(slots, "__slot").where("low <= __x and __x < high").groupBy(user, item).agg(F.min("__j").alias("__j"))
        return hits.join(taken, [user, item], "left_anti")

    def first(found: DataFrame, wanted: Column, before: Column) -> DataFrame:
        """The first of a user's hits as ranks after those found before."""
        r = F.row_number().over(Window.partitionBy(user).orderBy("__j"))
        return found.withColumn("__r", r).where(F.col("__r") <= wanted).select(user, item, (F.col("__r") + before).cast("int").alias("rank"))

    out, draws, short = None, num * DRAWS, stored(with_cuts(users, known))
    for _ in range(ROUNDS):
        found = stored(first(drawn(short, known, F.lit(draws), seed), F.lit(num), F.lit(0)))
        done = found.groupBy(user).agg(F.count("*").alias("__n")).where(F.col("__n") >= num).select(user)
        full = found.join(done, user, "left_semi")
        out = full if out is None else out.unionByName(full)
        short, draws = stored(short.join(done, user, "left_anti")), draws * 4
        if short.first() is None:
            return out
    mine = stored(found.join(short.select(user), user, "left_semi"))
    length = (F.col("high") - F.col("low")).alias("__w")
    for again in range(1, num + 2):
        taken = stored(known.join(short.select(user), user, "left_semi").unionByName(mine.select(user, item)))
        spent = taken.join(line.select(item, length), item).groupBy(user).agg(F.sum("__w").alias("__spent"), F.count("*").alias("__items"))
        have = mine.groupBy(user).agg(F.count("*").alias("__have"))
        state = with_cuts(short.select(user), taken).join(spent, user, "left").join(have, user, "left").withColumn("__have", F.coalesce("__have", F.lit(0)))
        state = state.where((F.col("__have") < num) & (F.coalesce("__items", F.lit(0)) < n))
        left = F.greatest(F.lit(total) - F.coalesce("__spent", F.lit(0.0)), F.lit(1e-12 * total))
        asked = F.ceil((num - F.col("__have")) * DRAWS * F.col("__room") / left)
        state = stored(state.withColumn("__draws", F.least(asked, F.lit(n + 1)).cast("int")))
        short = state.select(user)
        if state.first() is None:
            break
        new = first(drawn(state.where(F.col("__draws") <= n), taken, F.col("__draws"), seed + 1000 * again).join(state.select(user, "__have"), user), num - F.col("__have"), F.col("__have"))
        # by the weights themselves: beside a very heavy item a light one may have no length on the line
        own = items.select(item, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w")).where("__w > 0")
        every = state.where(F.col("__draws") > n).select(user, "__have").crossJoin(own).join(taken, [user, item], "left_anti")
        key = F.ln(uniform(user, item, seed=seed)) / F.col("__w")
        ranked = every.withColumn("__r", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(key), item))).where(F.col("__r") <= num - F.col("__have"))
        mine = stored(mine.unionByName(new).unionByName(ranked.select(user, item, (F.col("__r") + F.col("__have")).cast("int").alias("rank"))))
    return out.unionByName(mine)


def hard_negatives(positives: DataFrame, hard_edges: DataFrame, user: str, item: str, num: int, weight: str | None = None) -> DataFrame:
    """(user, item, rank): each user's hard edges, at most `num` of the heaviest."""
    users = positives.select(user).distinct()
    w = Window.partitionBy(user).orderBy(*([F.desc(weight)] if weight else []), item)
    return users.join(hard_edges, user).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= num).select(user, item, "rank")


def negatives_with_hard(easy: DataFrame, hard: DataFrame) -> DataFrame:
    """Both kinds in one table, hard ones after the easy ones and marked."""
    return easy.withColumn("hard", F.lit(False)).unionByName(hard.withColumn("hard", F.lit(True)))


def merge_negatives(batch: DataFrame, negatives: DataFrame, item_columns: list[str]) -> DataFrame:
    """Positive rows and the negatives' item columns in one table; `group` tells which."""
    return batch.select(*item_columns, F.lit("base").alias("group")).unionByName(negatives.select(*item_columns, F.lit("neg").alias("group")))


def flatten_positives(df: DataFrame, positives: str, out: str) -> DataFrame:
    """One row for each positive of a list, the other columns repeated."""
    return df.select(*[c for c in df.columns if c != positives], F.explode(positives).alias(out))


def append_candidates(sequence: Column, candidates: Column, separator: str | None = None) -> Column:
    """A sequence with candidates after it, as a list or as joined text."""
    return F.concat(sequence, candidates) if separator is None else F.concat_ws(separator, F.when(sequence != "", sequence), F.array_join(candidates, separator))


# --- trees ----------------------------------------------------------------------------


def parent(code: Column, branches: int) -> Column:
    """The code of a node's parent, in whole numbers; the root has none."""
    return F.call_function("div", code - 1, F.lit(branches)).cast("bigint")


def ancestors(code: Column, branches: int) -> Column:
    """Codes from a node's parent up to the root (0), nearest first; children of c are branches * c + 1 and on.

    The code is bound once, as a lambda's argument, and each step divides the
    step before it: an expression behind `code` is worked out once for a row.
    """
    levels, reach = 0, 0  # `levels` steps bring any long to the root
    while reach < (1 << 63) - 1:
        levels, reach = levels + 1, reach * branches + branches if branches > 1 else (1 << 63)
    if branches < 2:
        return F.when(code > 0, F.reverse(F.sequence(F.lit(0).cast("bigint"), code - 1))).otherwise(F.array().cast("array<bigint>"))
    state = F.struct(code.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("up"))

    def step(s: Column, _: Column) -> Column:
        up = parent(s["at"], branches)
        return F.when(s["at"] > 0, F.struct(up.alias("at"), F.concat(s["up"], F.array(up)).alias("up"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), state, step, lambda s: s["up"])


def kept_levels(top: int, kind: str, share: float, *batch: Column | str | int, seed: int = 0) -> Column:
    """The levels of which a batch keeps the positives: the last, and round(share * (top - 1)) others.

    These are drawn once for the batch, without replacement, with chances that
    are UNIFORM, ARITHMETIC (rising with the level) or RECIPROCAL (in the
    distance to the last level).
    """
    chance = {"UNIFORM": lambda lv: 1.0, "ARITHMETIC": float, "RECIPROCAL": lambda lv: 1.0 / (top - lv)}[kind]
    inner = [F.struct((-F.ln(uniform(*batch, lv, seed=seed)) / chance(lv)).alias("k"), F.lit(lv).alias("lv")) for lv in range(1, top)]
    if not inner:
        return F.array(F.lit(top))
    return F.concat(F.transform(F.slice(F.array_sort(F.array(*inner)), 1, round(share * len(inner))), lambda s: s["lv"]), F.array(F.lit(top)))


def tree_samples(
    positives: DataFrame, nodes: DataFrame, user: str, item: str, branches: int, negatives: dict[int, int], seed: int = 0, remain_share: float = 1.0, kind: str = "UNIFORM", batch: str | None = None,
) -> DataFrame:
    """(user, item, level, tree_code, label): all ancestors of each positive and, level by level, negatives of the same level.

    `nodes` has (item_id, tree_code, level); `negatives` the number by level.
    Negatives are distinct and not the positive itself: places of a level are
    numbered, and a row takes a run of places from a hashed start on, so the
    join is by equal place and never meets a whole level; only rows of levels
    with negatives are joined at all.  Paths are worked out once for a leaf, not
    for each of its positives.  With a `remain_share`
    below 1 each batch (all rows, unless a column `batch` tells them apart)
    keeps only some levels.
    """
    path = F.concat(F.array(F.col("tree_code").cast("bigint")), ancestors(F.col("tree_code"), branches))
    leaf = nodes.select(F.col("item_id").alias(item), F.col("level").alias("leaf_level"), path.alias("path"))
    top = nodes.agg(F.max("level").alias("m")).first()["m"] or 0
    drawn = (F.col(batch) if batch else F.lit(0)).alias("__batch")
    rows = positives.select(user, item, drawn).join(leaf, item).select(user, item, "__batch", "leaf_level", F.posexplode("path").alias("up", "tree_code"))
    rows = rows.withColumn("level", F.col("leaf_level") - F.col("up")).where("tree_code > 0").drop("leaf_level", "up")
    if remain_share < 1.0:
        rows = rows.where(F.array_contains(kept_levels(top, kind, remain_share, "__batch", seed=seed + 7), F.col("level")))
    rows = rows.drop("__batch")
    positive = rows.select(user, item, "level", "tree_code", F.lit(1).alias("label"))
    negatives = {lv: n for lv, n in negatives.items() if n > 0}
    if not negatives:
        return positive
    asked_of = F.col("level").isin(*negatives)
    placed = stored(ranked_within(nodes.where(asked_of).select("level", F.col("tree_code").cast("bigint").alias("tree_code")), "level", "tree_code", "tree_code", "place"))
    sizes = placed.groupBy("level").agg(F.count("*").alias("size"))
    n_placed = placed.count()
    wanted = F.create_map(*[F.lit(x) for lv, n in negatives.items() for x in (lv, n)])[F.col("level")]
    own = rows.where(asked_of).join(small_side(placed, n_placed), ["level", "tree_code"]).join(F.broadcast(sizes), "level").withColumn("n", F.least(wanted, F.col("size") - 1))
    start = F.floor(uniform(user, item, "level", seed=seed) * (F.col("size") - 1)).cast("bigint")
    # steps 1 .. size - 1 from the own place on reach every other place once
    step = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")
    asked = own.where("n > 0").withColumn("start", start).select(user, item, "level", "place", "size", "start", step)
    asked = asked.withColumn("place", ((F.col("place") + 1 + (F.col("start") + F.col("j")) % (F.col("size") - 1)) % F.col("size")))
    negative = asked.join(small_side(placed, n_placed), ["level", "place"]).select(user, item, "level", "tree_code", F.lit(0).alias("label"))
    return positive.unionByName(negative)


def expand_tree_samples(samples: DataFrame, users: DataFrame, nodes: DataFrame, user: str) -> DataFrame:
    """Training rows: each sample (user, item, level, tree_code, label) with its user's columns and its node's."""
    return samples.join(users, user).join(nodes.drop("item_id", "level"), "tree_code")


def tree_children(frontier: DataFrame, branches: int) -> DataFrame:
    """The children's codes of each row's tree_code, for prediction level by level."""
    return frontier.withColumn("child_code", F.explode(F.sequence(F.col("tree_code") * branches + 1, F.col("tree_code") * branches + branches)))


# --- batches and positions ---------------------------------------------------------------


def row_ranges(rows: int, workers: int) -> list[tuple[int, int]]:
    """Equal ranges, the first ones a row longer where it does not divide."""
    base, more = divmod(rows, workers)
    edges = [0]
    for i in range(workers):
        edges.append(edges[-1] + base + (i < more))
    return list(zip(edges[:-1], edges[1:]))


def ranges_over_tables(rows: list[int], workers: int) -> list[list[tuple[int, int, int]]]:
    """(table, first, last + 1) of each worker: the tables end to end, dealt in equal ranges."""
    starts, at = [], 0
    for n in rows:
        starts.append(at)
        at += n
    out = []
    for low, high in row_ranges(at, workers):
        out.append([(t, max(low, s) - s, min(high, s + n) - s) for t, (s, n) in enumerate(zip(starts, rows)) if max(low, s) < min(high, s + n)])
    return out


def remaining_ranges(rows: int, consumed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of range(rows) after ranges that were read, whoever read them."""
    out, at = [], 0
    for low, high in sorted(consumed):
        if low > at:
            out.append((at, low))
        at = max(at, high)
    if at < rows:
        out.append((at, rows))
    return out


def redistribute(ranges: list[tuple[int, int]], workers: int) -> list[list[tuple[int, int]]]:
    """Deal ranges to another number of workers in equal shares."""
    sizes = [b - a for a, b in ranges]
    return [[(ranges[t][0] + a, ranges[t][0] + b) for t, a, b in own] for own in ranges_over_tables(sizes, workers)]


def cost_batches(df: DataFrame, order: str, cost: str, limit: float, lane: str) -> DataFrame:
    """Add `batch`: consecutive rows of a lane whose costs sum to at most `limit`, greedily; a dearer row is a batch alone."""
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        number, total, out = 0, 0.0, np.empty(len(rows), np.int64)
        for i, c in enumerate(rows[cost].to_numpy(float)):
            if i and total + c > limit:
                number, total = number + 1, 0.0
            total += c
            out[i] = number
        return rows.assign(batch=out)

    return df.groupBy(lane).applyInPandas(run, schema)


def fixed_batches(df: DataFrame, order: str, size: int, lane: str, drop_remainder: bool = False) -> DataFrame:
    """Add `batch`: every `size` consecutive rows of a lane; a short last batch may go."""
    w = Window.partitionBy(lane)
    out = df.withColumn("batch", F.floor((F.row_number().over(w.orderBy(order)) - 1) / size).cast("long"))
    return out.withColumn("__n", F.count("*").over(w)).where((F.col("batch") + 1) * size <= F.col("__n")).drop("__n") if drop_remainder else out


def shuffled(df: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """All rows in an order drawn from the seed."""
    return df.orderBy(uniform(*keys, seed=seed), *keys)


def reservoir(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """A uniform sample of n rows: the smallest hashes, found by partial top-n in every task."""
    return df.orderBy(uniform(*keys, seed=seed), *keys).limit(n)
