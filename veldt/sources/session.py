"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables are broadcast up to about so many bytes, by their counted rows; beyond, their joins shuffle.
BROADCAST_BYTES = 32 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Of repeated keys in key-value text the last one wins."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name that driver and executors share: in spark.checkpoint.dir, or a temporary one where all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='veldt-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once and read again: later steps see the same rows, whoever is lost."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(small: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """The side of a join as a broadcast, where `rows` of about `row_bytes` each stay within BROADCAST_BYTES."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small
