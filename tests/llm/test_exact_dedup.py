import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import exact_dedup as X


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    f = X.FuseFilter.build(np.r_[keys, keys[:5]])
    assert f.contains(keys).all()
    others = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.02


def brute(rows):
    keep, size = {}, {}
    for i, t in rows:
        k = X_norm(t)
        keep[k] = min(keep.get(k, i), i)
        size[k] = size.get(k, 0) + 1
    return sorted((i, keep[X_norm(t)], size[X_norm(t)]) for i, t in rows)


def X_norm(t):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("digest", [lambda t: F.unhex(F.sha2(t, 256)), lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 2)), lambda t: F.lit(b"same")])
def test_bytes_decide_whatever_the_digest(spark, documents, odd, digest):
    """A digest of eight bits or of none collides everywhere and changes nothing."""
    df = documents.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    got = sorted(set((r["id"], r["keep_id"], r["group_size"]) for r in X.exact_dedup(df, digest=digest).collect()))
    assert got == sorted(set(brute([tuple(r) for r in df.collect()])))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_any_ids(odd_ids, kind):
    """Ids that are null, repeated, very large, or strings."""
    from pyspark.sql import functions as F

    df = odd_ids.withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    keep, size = {}, {}
    for i, t in rows:
        k = X_norm(t)
        keep[k] = min((x for x in (keep.get(k), i) if x is not None), default=None)
        size[k] = size.get(k, 0) + 1
    want = sorted(((i, keep[X_norm(t)], size[X_norm(t)], i == keep[X_norm(t)]) for i, t in rows), key=str)
    got = sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_dedup(df).collect()), key=str)
    assert got == want


def test_split_of_snapshot_and_batch_does_not_matter(spark, documents):
    want = brute([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    for old in (F.lit(True), F.lit(False), F.col("id") % 2 == 0):
        got = sorted((r["id"], r["keep_id"], r["group_size"]) for r in X.exact_dedup(documents, old=old).collect())
        assert got == want


def test_stored_snapshot(spark, tmp_path):
    from veldt.llm.session import prepare

    prepare(spark)
    keys = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"b")], "id long, digest binary")
    X.build_snapshot(keys, 3).save(str(tmp_path / "s"))
    again = X.Snapshot.load(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([(9, b"b"), (8, b"c"), (7, b"c")], "id long, digest binary")
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in X.match_batch(batch, again).collect()}
    assert got == {b"a": (1, 1), b"b": (2, 3), b"c": (7, 2)}
