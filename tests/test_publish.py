"""Publication of deltas: replays, crashes, late batches, replacement, compaction."""

import pytest
from pyspark.sql import functions as F

from veldt.streaming import publish as P

KEYS = ["key"]


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), "key string, global_step long, value double")


def table(spark, path):
    return {r["key"]: (r["global_step"], r["value"]) for r in P.published(spark, path, KEYS).collect()}


def test_replays_and_late_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.published(spark, path, KEYS)
    assert P.publish_batch(rows(spark, ("a", 5, 1.0), ("a", 4, 0.5), ("b", 5, 2.0)), 0, path, KEYS, clock=lambda: 100)
    assert not P.publish_batch(rows(spark, ("a", 9, 9.0)), 0, path, KEYS), "a committed batch is not written again"
    assert P.publish_batch(rows(spark, ("a", 3, 7.0), ("b", 5, 3.0), ("c", 1, 4.0)), 1, path, KEYS, clock=lambda: 50)
    # an older step never wins; of equal steps the one published last does, though its clock was behind
    assert table(spark, path) == {"a": (5, 1.0), "b": (5, 3.0), "c": (1, 4.0)}
    assert [c["time"] for c in P.commits(spark, path)] == [100, 101]
    assert {r["key"] for r in P.published_after(spark, path, 100).collect()} == {"a", "b", "c"}
    with pytest.raises(FileNotFoundError):
        P.published_after(spark, path, 101)


@pytest.mark.parametrize("at", ["send", "commit"])
def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch, at):
    path, sent = str(tmp_path / "t"), []
    P.publish_batch(rows(spark, ("a", 1, 1.0)), 0, path, KEYS)

    def die(*_):
        raise KeyboardInterrupt

    if at == "send":
        with pytest.raises(KeyboardInterrupt):
            P.publish_batch(rows(spark, ("a", 2, 2.0), ("gone", 2, 2.0)), 1, path, KEYS, send=die)
    else:
        with monkeypatch.context() as m:
            m.setattr(P, "commit", die)
            with pytest.raises(KeyboardInterrupt):
                P.publish_batch(rows(spark, ("a", 2, 2.0), ("gone", 2, 2.0)), 1, path, KEYS)
    assert table(spark, path) == {"a": (1, 1.0)}, "rows without a commit are not there"
    assert P.publish_batch(rows(spark, ("a", 2, 2.5)), 1, path, KEYS, send=lambda df, now: sent.append((df.count(), now)))
    assert table(spark, path) == {"a": (2, 2.5)} and len(sent) == 1


def test_retries(spark, tmp_path):
    path, tries = str(tmp_path / "t"), []

    def flaky(df, now):
        tries.append(now)
        if len(tries) < 3:
            raise ConnectionError("busy")

    assert P.publish_batch(rows(spark, ("a", 1, 1.0)), 0, path, KEYS, attempts=3, send=flaky)
    assert len(tries) == 3 and len(P.commits(spark, path)) == 1
    with pytest.raises(ConnectionError):
        P.publish_batch(rows(spark, ("a", 2, 1.0)), 1, path, KEYS, attempts=2, send=lambda *_: (_ for _ in ()).throw(ConnectionError()))
    assert len(P.commits(spark, path)) == 1


def test_replacement_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        P.publish_batch(rows(spark, (f"k{i}", i, float(i)), ("all", i, float(i))), i, path, KEYS, clock=lambda: 10)
    before = table(spark, path)
    P.compact(spark, path, KEYS)
    P.compact(spark, path, KEYS)
    assert table(spark, path) == before and sum(bool(c.get("compacts")) for c in P.commits(spark, path)) == 1
    assert P.published_after(spark, path, 9).count() == 6, "followers are not sent the base"
    assert not P.publish_batch(rows(spark, ("x", 1, 1.0)), 2, path, KEYS), "batches before the base stay known"
    P.publish_batch(rows(spark, ("all", 1, 9.0), ("new", 1, 1.0)), 3, path, KEYS)
    assert table(spark, path) == before | {"new": (1, 1.0)}
    P.publish_batch(rows(spark, ("only", 0, 0.0)), 4, path, KEYS, mode="replace")
    assert table(spark, path) == {"only": (0, 0.0)}
    with pytest.raises(ValueError, match="mode"):
        P.publish_batch(rows(spark), 5, path, KEYS, mode="upsert")


def test_stream(spark, tmp_path):
    """A stream whose state is lost repeats its batches; the table stays the same."""
    base = str(tmp_path)
    for i in range(3):
        rows(spark, ("a", i, float(i)), (f"k{i}", i, float(i))).coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema

    def play(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        P.publish_stream(stream, f"{base}/t", f"{base}/{state}", KEYS).trigger(availableNow=True).start().awaitTermination()

    play("s1")
    first, times = table(spark, f"{base}/t"), [c["time"] for c in P.commits(spark, f"{base}/t")]
    play("s2")
    assert table(spark, f"{base}/t") == first == {"a": (2, 2.0), "k0": (0, 0.0), "k1": (1, 1.0), "k2": (2, 2.0)}
    assert [c["time"] for c in P.commits(spark, f"{base}/t")] == times
    assert spark.read.parquet(f"{base}/t/deltas/batch=0").where(F.col(P.TIME) > 0).count() == 2
