"""The running table of managed ids against a dictionary that counts and evicts step by step."""

import random

import pytest

from veldt.streaming import managed as M
from veldt.streaming import publish


def brute(events, size, interval, policy, decay, min_count):
    held, last = {}, max(s for _, s in events)
    for step in range(1, last + 1):
        for i, s in events:
            if s == step and i is not None:
                n, _ = held.get(i, (0, 0))
                held[i] = (n + 1, step)
        if step % interval == 0:
            worth = {"lfu": lambda n, a: n, "lru": lambda n, a: 1 / a**decay, "distance_lfu": lambda n, a: n / a**decay}[policy]
            best = sorted((i for i in held if held[i][0] >= min_count), key=lambda i: (-worth(held[i][0], step - held[i][1] + 1), i))[:size]
            held = {i: held[i] for i in best}
    return {(i, n, s) for i, (n, s) in held.items()}


def table(spark, path):
    return {tuple(r) for r in M.managed_table(spark, path).collect()}


@pytest.mark.parametrize("policy, decay, min_count", [("lfu", 1.0, 1), ("lru", 1.0, 2), ("distance_lfu", 0.5, 1)])
def test_against_a_dictionary(spark, tmp_path, policy, decay, min_count):
    rng, path = random.Random(5), str(tmp_path / "t")
    events = [(rng.choice([None, *range(3), *range(25)]), s) for s in range(1, 48) for _ in range(rng.randrange(6))]
    how = dict(size=6, interval=5, policy=policy, decay=decay, min_count=min_count)
    edges = [0, 3, 4, 19, 20, 47]
    for number, (a, b) in enumerate(zip(edges, edges[1:])):
        batch = spark.createDataFrame([e for e in events if a < e[1] <= b], "id int, step int")
        assert M.manage_batch(batch, number, path, "id", "step", **how)
        assert not M.manage_batch(batch, number, path, "id", "step", **how), "a batch counts once"
        so_far = [e for e in events if e[1] <= b]
        assert table(spark, path) == brute(so_far, 6, 5, policy, decay, min_count)


def test_killed_before_its_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *e: spark.createDataFrame(list(e), "id int, step int")
    with pytest.raises(FileNotFoundError):
        M.managed_table(spark, path)
    M.manage_batch(rows((1, 1), (1, 2)), 0, path, "id", "step", 3, 10)
    with monkeypatch.context() as m:
        m.setattr(publish, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            M.manage_batch(rows((1, 3), (2, 3)), 1, path, "id", "step", 3, 10)
    assert table(spark, path) == {(1, 2, 2)}
    M.manage_batch(rows((1, 3), (2, 3)), 1, path, "id", "step", 3, 10)
    assert table(spark, path) == {(1, 3, 3), (2, 1, 3)}
    M.manage_batch(rows(), 2, path, "id", "step", 3, 10)
    assert table(spark, path) == {(1, 3, 3), (2, 1, 3)}
    with pytest.raises(ValueError):
        M.manage_batch(rows(), 3, path, "id", "step", 0, 10)


def test_stream(spark, tmp_path):
    base = str(tmp_path)
    for s in (1, 2, 3):
        spark.createDataFrame([(i, s) for i in range(s * 3)], "id int, step int").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def play(state):
        stream = spark.readStream.schema("id int, step int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        M.managed_ids(stream, f"{base}/t", f"{base}/{state}", "id", "step", 4, 2).trigger(availableNow=True).start().awaitTermination()

    play("a")
    want = brute([(i, s) for s in (1, 2, 3) for i in range(s * 3)], 4, 2, "lfu", 1.0, 1)
    assert table(spark, f"{base}/t") == want
    play("b")  # its state was lost: the same batches are given again
    assert table(spark, f"{base}/t") == want


@pytest.mark.parametrize("policy, decay, min_count", [("lfu", 1.0, 1), ("lru", 1.0, 2), ("distance_lfu", 0.5, 1)])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_no_job_for_an_eviction(spark, tmp_path, monkeypatch, kind, policy, decay, min_count):
    """A batch of many evictions costs as many jobs as one of few, also where new ids are dropped before their eviction."""
    rng, path = random.Random(6), str(tmp_path / "t")
    name = (lambda i: i) if kind == "int" else (lambda i: f"é{i}")
    events = [(name(rng.choice([*range(4), *range(300)])), s) for s in range(1, 400) if not 100 < s < 130 for _ in range(rng.randrange(8))]
    how = dict(size=6, interval=2, policy=policy, decay=decay, min_count=min_count)
    monkeypatch.setattr(M, "HELD_BACK", 1)
    monkeypatch.setattr(M, "evicted", lambda *_, **__: pytest.fail("an eviction is no job"))
    for number, (a, b) in enumerate([(0, 3), (3, 350), (350, 399)]):
        M.manage_batch(spark.createDataFrame([e for e in events if a < e[1] <= b], f"id {kind}, step int"), number, path, "id", "step", **how)
        assert table(spark, path) == brute([e for e in events if e[1] <= b], 6, 2, policy, decay, min_count)


def test_tables_too_large_for_a_task(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    events = [(rng.randrange(40), s) for s in range(1, 24) for _ in range(5)]
    monkeypatch.setattr(M, "TASK_SIZE", 5)
    M.manage_batch(spark.createDataFrame(events, "id int, step int"), 0, str(tmp_path / "t"), "id", "step", 6, 10, policy="distance_lfu", decay=0.5)
    assert table(spark, str(tmp_path / "t")) == brute(events, 6, 10, "distance_lfu", 0.5, 1)
