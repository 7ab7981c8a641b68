"""A running table of managed ids: counts grow with the stream, and every so many steps the best stay.

The table is stored as a version for each micro-batch, with a commit file written
last; a batch that was committed is not counted again, and one that a crash left
half done is written anew.  What was evicted is forgotten: an id that comes back
begins with a count of 0.

Evictions follow one another, however many a batch has, so a job for each would
take longer than its rows.  Tasks count the ids between two evictions; then one
task goes through these counts in order, holding the `size` ids of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bucketize import admission_score, admission_scores
from ..sources.session import stored
from . import publish

#: Tables of more ids are no task's to hold: each of their evictions is a job over the whole table.
TASK_SIZE = 1_000_000
#: Ids between two evictions that a task holds beside the table before it drops those that cannot stay.
HELD_BACK = 100_000


def counted(table: DataFrame | None, events: DataFrame, id_col: str, step_col: str) -> DataFrame:
    """The table (id, cnt, last_step) with the events' counts added; summed up before the shuffle, whatever the hottest id."""
    new = events.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("cnt"), F.max(step_col).cast("long").alias("last_step"))
    if table is None:
        return new
    return table.unionByName(new).groupBy("id").agg(F.sum("cnt").alias("cnt"), F.max("last_step").alias("last_step"))


def evicted(table: DataFrame, now: int, size: int, policy: str = "lfu", decay: float = 1.0, min_count: int = 1) -> DataFrame:
    """The `size` ids of the best score at step `now`, equal ones by id, by a partial top-n in every task."""
    score = admission_score(policy, F.lit(now), decay)
    return table.where(F.col("cnt") >= min_count).orderBy(F.desc(score), "id").limit(size).select("id", "cnt", "last_step")


def _best(ids: np.ndarray, cnt: np.ndarray, last: np.ndarray, now: int, size: int, policy: str, decay: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `evicted` keeps, sorted by id."""
    order = np.argsort(ids, kind="stable")
    order = order[cnt[order] >= min_count]
    ids, cnt, last = ids[order], cnt[order], last[order]
    if len(ids) > size:
        score = admission_scores(policy, cnt, last, now, decay)
        edge = np.partition(score, len(score) - size)[len(score) - size]
        stay = score > edge
        stay[np.flatnonzero(score == edge)[: size - stay.sum()]] = True
        ids, cnt, last = ids[stay], cnt[stay], last[stay]
    return ids, cnt, last


def evicted_in_order(table: DataFrame | None, events: DataFrame, id_col: str, step_col: str, size: int, interval: int, first: int, policy: str = "lfu", decay: float = 1.0, min_count: int = 1) -> DataFrame:
    """The table after the evictions at all multiples of `interval` of which the last one is that of the latest event; the first one is number `first`.

    An id's count between two evictions is one row, whatever the hottest id, and
    rows come in the order of evictions and ids.  The task that gets them holds
    the table and, of the ids that are new between two evictions, at most
    HELD_BACK more than can stay.  Where nothing is counted between two
    evictions, the second one changes nothing.
    """
    turn = F.call_function("div", F.ceil(step_col) + F.lit(interval - 1), F.lit(interval))
    rows = events.where(F.col(id_col).isNotNull()).groupBy(turn.alias("turn"), F.col(id_col).alias("id")).agg(F.count("*").alias("cnt"), F.max(step_col).cast("long").alias("last_step"))
    if table is not None:
        rows = rows.unionByName(table.select(F.lit(first).cast("long").alias("turn"), "id", "cnt", "last_step")).groupBy("turn", "id").agg(F.sum("cnt").alias("cnt"), F.max("last_step").alias("last_step"))
    kind = rows.schema["id"].dataType
    best = lambda parts, turn: _best(*[np.concatenate(x) for x in zip(*parts)], turn * interval, size, policy, decay, min_count)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, new, n, names = None, None, [], 0, None
        for batch in batches:
            turns = batch.column(0).to_numpy()
            names = batch.schema.field(1).type
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            edges = [0, *(np.flatnonzero(turns[1:] != turns[:-1]) + 1), len(turns)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if at is not None and turns[low] != at:
                    held, new, n = best([held, *new] if held else new, at), [], 0
                at = int(turns[low])
                ids, cnt, last = (c[low:high] for c in columns)
                if held and len(held[0]):
                    place = np.minimum(np.searchsorted(held[0], ids), len(held[0]) - 1)
                    known = held[0][place] == ids
                    held[1][place[known]] += cnt[known]
                    held[2][place[known]] = np.maximum(held[2][place[known]], last[known])
                    ids, cnt, last = ids[~known], cnt[~known], last[~known]
                new.append((ids, cnt, last))
                n += len(ids)
                if n > size + HELD_BACK:
                    new, n = [best(new, at)], size
        if at is not None:
            held = best([held, *new] if held else new, at)
            yield pa.RecordBatch.from_arrays([pa.array(held[0], names), pa.array(held[1]), pa.array(held[2])], names=["id", "cnt", "last_step"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("cnt", T.LongType()), T.StructField("last_step", T.LongType())])
    return rows.select("turn", "id", "cnt", "last_step").repartition(1).sortWithinPartitions("turn", "id").mapInArrow(walk, schema)


def manage_batch(events: DataFrame, number: int, path: str, id_col: str, step_col: str, size: int, interval: int, **policy) -> bool:
    """Count a batch of events (id, step) and evict at every multiple of `interval` that their steps pass; whether it was counted now.

    Steps of a batch lie after those of the batches before it.  Events up to a
    multiple are counted before it evicts.
    """
    if interval < 1 or size < 1:
        raise ValueError("size and interval must be positive")
    spark = events.sparkSession
    done = publish.commits(spark, path)
    if any(c["batch"] == number for c in done):
        return False
    table = spark.read.parquet(f"{path}/{done[-1]['folder']}") if done else None
    before = done[-1]["step"] if done else 0
    events = stored(events.select(id_col, step_col))
    last = events.agg(F.max(step_col).alias("last")).first()["last"]
    step, last = before, before if last is None else int(last)
    between = lambda low, high: events.where((F.col(step_col) > low) & (F.col(step_col) <= high))
    turns = range(step // interval + 1, last // interval + 1)
    if turns and size <= TASK_SIZE and isinstance(events.schema[id_col].dataType, T.AtomicType):
        step = turns[-1] * interval
        table = stored(evicted_in_order(table, between(before, step), id_col, step_col, size, interval, turns[0], **policy))
    else:
        for turn in turns:
            table = stored(counted(table, between(step, turn * interval), id_col, step_col))
            step = turn * interval
            table = stored(evicted(table, step, size, **policy))
    # what comes after the last eviction
    if step < last or table is None:
        table = counted(table, between(step, last), id_col, step_col)
    table.write.mode("overwrite").parquet(f"{path}/versions/batch={number}")
    publish.commit(spark, path, number, {"batch": number, "time": len(done), "step": last, "mode": publish.REPLACE, "folder": f"versions/batch={number}"})
    return True


def managed_ids(stream: DataFrame, path: str, checkpoint: str, id_col: str, step_col: str, size: int, interval: int, **policy):
    """A writer that keeps the table up to date with a stream; see manage_batch."""
    return stream.writeStream.foreachBatch(lambda rows, n: manage_batch(rows, n, path, id_col, step_col, size, interval, **policy)).option("checkpointLocation", checkpoint)


def managed_table(spark: SparkSession, path: str) -> DataFrame:
    """The table after the last committed batch."""
    done = publish.commits(spark, path)
    if not done:
        raise FileNotFoundError(f"{path} has no commit")
    return spark.read.parquet(f"{path}/{done[-1]['folder']}")
