"""Publishing changed rows so that replays, crashes and late batches leave one version.

A published table is a folder of deltas, one for each batch, and of commits, one
small file for each.  A batch is there once its commit is: rows that a crash left
without one are written anew, and a batch that was committed is not written
again, whoever repeats it.  Publication times rise from commit to commit, so a
reader that asks for what came after a time misses nothing.  Readers merge by
key; compaction does that once for all batches so far.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.deltas import latest

#: What a batch does with rows of keys that it does not hold.
MERGE, REPLACE = "merge", "replace"
TIME = "published_ms"


def clock_ms() -> int:
    return int(time.time() * 1000)


def commits(spark: SparkSession, path: str) -> list[dict]:
    """Commits (batch, time, mode, folder) by time; one row for each published batch."""
    try:
        rows = spark.read.text(f"{path}/commits/*").collect()
    except AnalysisException as e:  # nothing was committed yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["time"])


def commit(spark: SparkSession, path: str, number: int, entry: dict) -> None:
    """Make a batch visible: one small file, written last."""
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/commits/batch={number}")


def publish_batch(
    rows: DataFrame, number: int, path: str, keys: list[str], order: str = "global_step", mode: str = MERGE, attempts: int = 3, backoff_seconds: float = 0.0, clock: Callable[[], int] = clock_ms,
    send: Callable[[DataFrame, int], None] | None = None,
) -> bool:
    """Publish the latest row of each key of a batch; whether it was published now, not before.

    `send` hands the stored rows to a remote store as well; writing, sending and
    committing are tried `attempts` times, with rising pauses.  `replace` makes
    the batch the whole table.  A batch without rows is committed, too.
    """
    if mode not in (MERGE, REPLACE):
        raise ValueError(f"mode must be {MERGE} or {REPLACE}, not {mode!r}")
    spark = rows.sparkSession
    for attempt in range(1, attempts + 1):
        try:
            done = commits(spark, path)
            if any(c["batch"] == number for c in done):
                return False
            now = max([clock(), *[c["time"] + 1 for c in done]])
            folder = f"{path}/deltas/batch={number}"
            latest(rows, keys, order).withColumn(TIME, F.lit(now).cast("long")).write.mode("overwrite").parquet(folder)
            if send is not None:
                send(spark.read.parquet(folder), now)
            commit(spark, path, number, {"batch": number, "time": now, "mode": mode, "folder": f"deltas/batch={number}"})
            return True
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(backoff_seconds * attempt)
    raise ValueError("at least one attempt")


def publish_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "global_step", **how):
    """A writer that publishes every micro-batch under its number; see publish_batch."""
    return stream.writeStream.foreachBatch(lambda rows, number: publish_batch(rows, number, path, keys, order, **how)).option("checkpointLocation", checkpoint)


def _since_base(done: list[dict]) -> list[dict]:
    whole = [i for i, c in enumerate(done) if c["mode"] == REPLACE]
    return done[whole[-1] :] if whole else done


def published(spark: SparkSession, path: str, keys: list[str], order: str = "global_step") -> DataFrame:
    """The table: of each key the row of the highest step, of equal steps the one published last."""
    held = _since_base(commits(spark, path))
    if not held:
        raise FileNotFoundError(f"{path} has no commit")
    rows = spark.read.parquet(*[f"{path}/{c['folder']}" for c in held])
    columns = rows.columns
    place = [c for c in columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*place), F.struct(order, TIME)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in place]).select(*columns)


def published_after(spark: SparkSession, path: str, since_ms: int) -> DataFrame:
    """Rows of the batches that were published after a time, for readers that follow; compactions repeat nothing."""
    fresh = [c for c in commits(spark, path) if c["time"] > since_ms and not c.get("compacts")]
    if not fresh:
        raise FileNotFoundError(f"{path} has no commit after {since_ms}")
    return spark.read.parquet(*[f"{path}/{c['folder']}" for c in fresh])


def compact(spark: SparkSession, path: str, keys: list[str], order: str = "global_step") -> None:
    """Store the merged table as a base of its own, from which readers begin; later batches come on top."""
    done = commits(spark, path)
    if not done or done[-1].get("compacts"):
        return
    now, number = done[-1]["time"] + 1, -1 - sum(bool(c.get("compacts")) for c in done)
    folder = f"bases/{now}"
    published(spark, path, keys, order).write.mode("overwrite").parquet(f"{path}/{folder}")
    commit(spark, path, number, {"batch": number, "time": now, "mode": REPLACE, "folder": folder, "compacts": True})
