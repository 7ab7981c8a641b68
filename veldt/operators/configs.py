"""Tables about features: statistics joined into definitions, selection, samples for serving."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import Feature

DROP = "DROP IT"


def without_dropped(info: DataFrame) -> DataFrame:
    """Rows whose message does not ask to drop the feature."""
    return info.where(~F.coalesce(F.col("message").contains(DROP), F.lit(False)))


def with_info(features: list[Feature], info: DataFrame) -> list[Feature]:
    """Definitions with the boundaries and hash sizes of a table (feature, boundaries, hash_size, message); dropped ones go."""
    rows = {r["feature"]: r for r in info.collect()}  # one row for each feature definition
    out = []
    for f in features:
        r = rows.get(f.name)
        if r is not None and DROP in (r["message"] or ""):
            continue
        if r is not None:
            f = replace(f, buckets=replace(f.buckets, **{k: v for k, v in (("boundaries", r["boundaries"]), ("hash_size", r["hash_size"])) if v is not None}))
        out.append(f)
    return out


def select_features(importance: DataFrame, top: int) -> DataFrame:
    """(group, feature, dropout, rank): features that dropout spares most, `top` of each group."""
    w = Window.partitionBy("group").orderBy("dropout", "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def request_sample(df: DataFrame, n: int) -> list[str]:
    """n rows as JSON, for trying a service."""
    return [r[0] for r in df.limit(n).select(F.to_json(F.struct(*df.columns))).collect()]
