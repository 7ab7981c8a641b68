"""Discretisation: hash, whole-number, vocabulary and boundary buckets."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of features whose ids are managed outside: the whole positive range.
UNBOUNDED_BUCKETS = 2**63 - 1


def hash_bucket(c: Column, n: int) -> Column:
    """A portable string hash modulo n: the first 60 bits of md5, so that other engines can repeat it."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(n).cast("bigint"))


def number_bucket(c: Column, n: int, default: int = 0) -> Column:
    """Whole numbers in [0, n), fractions cut; anything else is `default`."""
    x = c.try_cast("double").try_cast("bigint")
    return F.when(x.between(0, n - 1), x).otherwise(F.lit(default).cast("bigint"))


def boundary_bucket(c: Column, boundaries: list[float]) -> Column:
    """How many boundaries are at most the value: a value on a boundary belongs to the bucket above it."""
    bounds = F.array(*[F.lit(float(b)) for b in sorted(boundaries)])
    return F.when(c.isNotNull(), F.size(F.filter(bounds, lambda b: b <= c.cast("double")))).cast("bigint")


def vocabulary_of_list(words: list[str], default: str | None = None, oov: int | None = None) -> tuple[dict[str, int], int]:
    """Ids of listed words and the id of others: 0 is the default value, 1 unknown words, the list counts from 2.

    A default that is listed keeps its listed id.  With `oov` no ids are
    reserved: words count from 0 and unknown ones get `oov`.
    """
    if oov is not None:
        return {w: i for i, w in enumerate(words)}, oov
    ids = {w: i + 2 for i, w in enumerate(words)}
    if default is not None:
        ids.setdefault(default, 0)
    return ids, 1


def vocabulary_of_dict(words: dict[str, int], default: str | None = None, oov: int | None = None) -> tuple[dict[str, int], int]:
    """Ids as given; a default gets 0 even where the dictionary names it."""
    ids = dict(words)
    if oov is not None:
        return ids, oov
    if default is not None:
        ids[default] = 0
    return ids, 1


def vocabulary_bucket(c: Column, ids: dict[str, int], other: int) -> Column:
    """Look a word up in a vocabulary that is small enough to be part of the plan; larger ones go through `vocabulary_join`."""
    if not ids:
        return F.when(c.isNotNull(), F.lit(other)).cast("bigint")
    table = F.create_map(*[F.lit(x) for word, i in ids.items() for x in (word, i)])
    return F.when(c.isNotNull(), F.coalesce(table[c], F.lit(other))).cast("bigint")


#: A vocabulary table of at most so many rows is broadcast (about 64 MB); a larger one is joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def vocabulary_join(df: DataFrame, column: str, words: DataFrame, out: str, other: int = 1) -> DataFrame:
    """Add the id of a word from a table (token, id), `other` where it has none."""
    table = words.select(F.col("token").alias("__token"), F.col("id").alias("__id")).dropDuplicates(["__token"])
    table = F.broadcast(table) if table.count() <= BROADCAST_WORDS else table
    found = df.join(table, F.col(column) == F.col("__token"), "left")
    return found.withColumn(out, F.coalesce(F.col("__id"), F.lit(other)).cast("bigint")).drop("__token", "__id")


@dataclass(frozen=True)
class Bucketizer:
    """One way to turn values into ids; the first that is set wins, managed ids before hash, number and vocabulary."""

    managed: bool = False
    hash_size: int | None = None
    num_buckets: int | None = None
    vocab_list: list[str] | None = None
    vocab_dict: dict[str, int] | None = None
    boundaries: list[float] | None = None
    default_id: int | None = None
    default_value: str | None = field(default=None)

    def apply(self, c: Column) -> Column:
        if self.managed:
            return hash_bucket(c, UNBOUNDED_BUCKETS)
        if self.hash_size:
            return hash_bucket(c, self.hash_size)
        if self.num_buckets:
            return number_bucket(c, self.num_buckets, self.default_id or 0)
        if self.vocab_list is not None:
            return vocabulary_bucket(c, *vocabulary_of_list(self.vocab_list, self.default_value, self.default_id))
        if self.vocab_dict is not None:
            return vocabulary_bucket(c, *vocabulary_of_dict(self.vocab_dict, self.default_value, self.default_id))
        if self.boundaries is not None:
            return boundary_bucket(c, self.boundaries)
        return c

    @property
    def active(self) -> bool:
        return self.managed or any(x is not None for x in (self.hash_size, self.num_buckets, self.vocab_list, self.vocab_dict, self.boundaries))

    def num_embeddings(self) -> int:
        """Rows that an embedding table needs for these ids."""
        if self.managed:
            return UNBOUNDED_BUCKETS
        if self.hash_size or self.num_buckets:
            return self.hash_size or self.num_buckets
        if self.vocab_list is not None:
            return len(self.vocab_list) + (0 if self.default_id is not None else 2)
        if self.vocab_dict is not None:
            return max([*self.vocab_dict.values(), 1 if self.default_id is None else self.default_id]) + 1
        return len(self.boundaries or []) + 1


def admission_score(policy: str, now: Column, decay: float = 1.0) -> Column:
    """The worth of an id (cnt, last_step) at step `now`.

    Policies: lfu ranks by count, lru by recency 1 / (age ^ decay), distance_lfu
    by count / (age ^ decay); age is in steps behind `now`, plus one.
    """
    age = F.pow(now - F.col("last_step") + 1.0, F.lit(decay))
    return {"lfu": F.col("cnt").cast("double"), "lru": 1.0 / age, "distance_lfu": F.col("cnt") / age}[policy]


def admission_scores(policy: str, cnt: np.ndarray, last_step: np.ndarray, now: int, decay: float = 1.0) -> np.ndarray:
    """admission_score of many ids within a task."""
    if policy == "lfu":
        return cnt.astype(float)
    steps, at = np.unique(last_step, return_inverse=True)
    # the same power function for every age, whatever numpy was built with
    age = np.array([math.pow(now - s + 1.0, decay) for s in steps.tolist()])[at]
    return {"lru": np.ones(len(cnt)), "distance_lfu": cnt}[policy] / age


def admitted_ids(events: DataFrame, id_col: str, step_col: str, size: int, policy: str = "lfu", decay: float = 1.0, min_count: int = 1) -> DataFrame:
    """(id, cnt, last_step, score) of the ids that a managed table of `size` rows holds, by admission_score at the latest step."""
    stats = events.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("cnt"), F.max(step_col).alias("last_step")).where(F.col("cnt") >= min_count)
    now = events.agg(F.max(step_col).alias("now"))
    return stats.crossJoin(F.broadcast(now)).select("id", "cnt", "last_step", admission_score(policy, F.col("now"), decay).alias("score")).orderBy(F.desc("score"), "id").limit(size)
