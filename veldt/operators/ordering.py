"""Places of rows in an order that no task sorts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import stored


def placed_in_order(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add `out`: the place (from 0) of each row in the whole order, which no task sorts alone.

    Rows are sorted by ranges and stored; a row's place is its number in its
    range after the counts of the ranges before, of which there is one row each.
    """
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("__r")).agg(F.count("*").alias("__n")).select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = dealt.withColumn("__r", part).join(F.broadcast(starts), "__r")
    return placed.withColumn(out, F.col("__start") + F.col("__m") - F.shiftleft("__r", 33)).drop("__r", "__start", "__m")


def ranked_within(rows: DataFrame, key: str, order: str, tie: str, out: str) -> DataFrame:
    """Add `out`: the place (from 0) of each row among those of its key; no key is ordered by one task."""
    placed = placed_in_order(rows, [key, order, tie], "__at")
    return placed.join(placed.groupBy(key).agg(F.min("__at").alias("__first")), key).withColumn(out, F.col("__at") - F.col("__first")).drop("__at", "__first")
