"""Changed embedding rows: latest per key, publication, and checks against a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(deltas: DataFrame, keys: list[str], order: str = "global_step") -> DataFrame:
    """The row of the highest step of each key, by one aggregate."""
    rest = [c for c in deltas.columns if c not in keys]
    best = deltas.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*deltas.columns)


def changed_between(deltas: DataFrame, first: int, last: int, order: str = "global_step") -> DataFrame:
    """Rows of steps after `first` up to `last`."""
    return deltas.where((F.col(order) > first) & (F.col(order) <= last))


def merged(table: DataFrame, deltas: DataFrame, keys: list[str], order: str = "global_step") -> DataFrame:
    """The table with newer rows in place of older ones and new keys added."""
    return latest(table.unionByName(deltas.select(*table.columns)), keys, order)


def upload_batches(deltas: DataFrame, keys: list[str], size: int = 1000, lanes: int = 32) -> DataFrame:
    """Add lane and batch: at most `size` rows to a batch, numbered within lanes by key."""
    lane = F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int")
    w = Window.partitionBy("lane").orderBy(*keys)
    return deltas.withColumn("lane", lane).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Whether two vectors agree element by element."""
    same = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & same


def reconcile(local: DataFrame, remote: DataFrame, keys: list[str], vector: str = "embedding", quantised: bool = False) -> DataFrame:
    """(keys, status): MATCH, DIFFERENT or MISSING for every local row."""
    rtol, atol = (1e-3, 1e-3) if quantised else (1e-5, 1e-6)
    other = remote.select(*keys, F.col(vector).alias("__v"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "MISSING").when(close(F.col(vector), F.col("__v"), rtol, atol), "MATCH").otherwise("DIFFERENT")
    return local.join(other, keys, "left").select(*keys, status.alias("status"))


def reconcile_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("status").agg(F.count("*").alias("n"))
