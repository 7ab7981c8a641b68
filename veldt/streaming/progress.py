"""Progress of streams: positions, watermarks by quorum, event-time triggers, decayed metrics and delta dumps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.deltas import latest


def positions(rows: DataFrame, source: str, offset: str) -> DataFrame:
    """(source, position): the highest row or offset read of each source; merging workers is the same aggregate."""
    return rows.groupBy(source).agg(F.max(offset).alias("position"))


def unread(rows: DataFrame, state: DataFrame, source: str, offset: str) -> DataFrame:
    """Rows beyond the stored positions; a source without one is read from its start."""
    known = state.select(source, "position")
    return rows.join(known, source, "left").where(F.col("position").isNull() | (F.col(offset) > F.col("position"))).drop("position")


#: The source under which a state keeps how many times all data were read.
EPOCHS = "__epochs__"


def with_epochs(state: DataFrame, source: str, epochs: int) -> DataFrame:
    """A state of positions (text sources) with the number of finished passes; finishing one starts the positions anew."""
    return state.where(F.col(source) != EPOCHS).select(source, "position").unionByName(state.sparkSession.createDataFrame([(EPOCHS, epochs)], f"`{source}` string, position long"))


def epochs_done(state: DataFrame, source: str) -> int:
    """Finished passes over all data, 0 where the state names none."""
    row = state.where(F.col(source) == EPOCHS).agg(F.max("position").alias("n")).first()
    return row["n"] or 0


def batch_event_time(rows: DataFrame, batch: str, time: str) -> DataFrame:
    """(batch, event_time): the latest time in seconds, -1 where a batch has none."""
    return rows.groupBy(batch).agg(F.coalesce(F.max(F.col(time).cast("timestamp").cast("double")), F.lit(-1.0)).alias("event_time"))


def quorum_time(reached: Column, quorum: float) -> Column:
    """The latest time that at least ceil(quorum * m) of m workers reached, from an array of their times; null for none."""
    times = F.sort_array(F.filter(reached, lambda x: x.isNotNull()))
    need = F.greatest(F.lit(1), F.ceil(F.lit(quorum) * F.size(times) - F.lit(1e-9)).cast("int"))
    return F.when(F.size(times) > 0, F.get(times, F.size(times) - need))


def quorum_watermark(workers: DataFrame, quorum: float, worker: str = "worker", time: str = "event_time") -> DataFrame:
    """One row: the quorum time over the workers' latest times; one time per worker is small."""
    latest_times = workers.groupBy(worker).agg(F.max(time).alias("t"))
    return latest_times.agg(F.collect_list("t").alias("ts")).select(quorum_time(F.col("ts"), quorum).alias("watermark"))


def fires(previous: float | None, now: float, interval: float, targets: list[float] = ()) -> bool:
    """Whether event time moved into another interval or past a target; the first observation never fires, an interval of 0 is none."""
    if previous is None or now < 0:
        return False
    return (interval > 0 and now // interval > previous // interval) or any(previous < t <= now for t in targets)


def event_time_trigger(stream: DataFrame, key: str, time: str, interval: float, targets: list[float] = ()) -> DataFrame:
    """(key, event_time, fired): a stateful operator that keeps each key's latest time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        now = max([float(b["t"].max()) for b in batches if len(b)], default=-1.0)
        fired = fires(previous, now, interval, targets)
        state.update((max(now, previous if previous is not None else now),))
        yield pd.DataFrame({key: [k[0]], "event_time": [now], "fired": [fired]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(time).cast("timestamp").cast("double").alias("t"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_time double, fired boolean", "latest double", "append", GroupStateTimeout.NoTimeout)


def decayed(values: list[float], decay: float) -> float:
    """The fold d * old + (1 - d) * new, beginning with the first value."""
    out = values[0]
    for v in values[1:]:
        out = decay * out + (1 - decay) * v
    return out


def decayed_metric(stream: DataFrame, key: str, value: str, decay: float) -> DataFrame:
    """(key, metric): a decayed running mean of each key's batch means, kept as state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = 0.0, 0
        for b in batches:
            total, n = total + float(b["v"].sum()), n + len(b)
        mean = total / max(1, n)
        new = decay * state.get[0] + (1 - decay) * mean if state.exists else mean
        state.update((new,))
        yield pd.DataFrame({key: [k[0]], "metric": [new]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, metric double", "metric double", "update", GroupStateTimeout.NoTimeout)


def delta_dump(stream: DataFrame, keys: list[str], path: str, checkpoint: str, order: str = "global_step", publish: Callable[[DataFrame, int], None] | None = None):
    """Write the latest row of each key of every micro-batch to its own folder; a repeated batch replaces itself."""

    def dump(batch: DataFrame, number: int) -> None:
        rows = latest(batch, keys, order)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if publish is not None:
            publish(rows, number)

    return stream.writeStream.foreachBatch(dump).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str, slide: str | None = None, session: bool = False) -> DataFrame:
    """Counts in tumbling, sliding or session windows; rows later than `late` are dropped."""
    w = F.session_window(time, width) if session else F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
