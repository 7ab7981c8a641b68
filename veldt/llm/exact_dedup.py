"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

A snapshot is a set of documents that no longer changes: one row per distinct
digest, plus one static 8-bit binary-fuse filter per digest bucket.  A batch of
new documents is first grouped by digest on its own.  Each distinct digest is
screened by the filter of its bucket: most new digests end there, and only
positives join the snapshot's exact rows.  Digests with more than one document
are then checked byte by byte, so a digest collision never merges two texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import bucket_count, prepare, read_table, saved
from .textops import mix

SPACES = r"[\x20\x09-\x0D]+"
#: Digests with copies are broadcast up to this many (64 bytes each, about 13 MB); beyond, the join shuffles.
BROADCAST_DIGESTS = 200_000


def normalised(text: Column) -> Column:
    """Runs of space and 0x09-0x0D become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


# --- binary fuse filter, arity 3, 8-bit fingerprints -------------------------------


def _cells(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells (3, n) of each key and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed))
    low = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


@dataclass(frozen=True)
class FuseFilter:
    """A static set membership filter: no false negatives, about 1 false positive in 256."""

    seed: int
    segment: int
    span: int
    prints: bytes

    @staticmethod
    def build(keys: np.ndarray) -> "FuseFilter":
        """Peel keys that are alone in a cell, all such keys of a round at once, and fill cells in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // segment) - 2)
        span, size = count * segment, (count + 2) * segment
        for attempt in range(200):
            seed = int(mix(np.array([attempt + 1], np.uint64))[0])
            cells, prints = _cells(keys, seed, segment, span)
            load = np.bincount(cells.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for row in cells:
                np.bitwise_xor.at(held, row, np.arange(n))
            rounds, left = [], n
            alone = np.flatnonzero(load == 1)
            while len(alone):
                peeled, at = np.unique(held[alone], return_index=True)
                rounds.append((peeled, alone[at]))
                left -= len(peeled)
                touched = cells[:, peeled]
                np.subtract.at(load, touched.ravel(), 1)
                for row in touched:
                    np.bitwise_xor.at(held, row, peeled)
                touched = np.unique(touched)
                alone = touched[load[touched] == 1]
            if not left:
                table = np.zeros(size, np.uint8)
                for peeled, cell in reversed(rounds):
                    own = cells[:, peeled]
                    table[cell] = prints[peeled] ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
                return FuseFilter(seed, segment, span, table.tobytes())
        raise RuntimeError("no seed gave a peelable filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        cells, prints = _cells(keys.astype(np.uint64), self.seed, self.segment, self.span)
        table = np.frombuffer(self.prints, np.uint8)
        return (table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]) == prints


def _build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(rows["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "seed": [str(f.seed)], "segment": [f.segment], "span": [f.span], "prints": [f.prints]})


def _screen_bucket(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keep = np.zeros(len(rows), bool)
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    for f in filters.itertuples():
        keep |= FuseFilter(int(f.seed), int(f.segment), int(f.span), f.prints).contains(keys)
    return rows[keep]


@dataclass(frozen=True)
class Snapshot:
    """One row per distinct digest (digest, keep_id, n, key, bucket) and one filter per bucket."""

    index: DataFrame
    filters: DataFrame
    buckets: int

    def save(self, path: str) -> None:
        self.index.withColumn("buckets", F.lit(self.buckets)).write.parquet(f"{path}/index")
        self.filters.write.parquet(f"{path}/filters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Snapshot":
        index = spark.read.parquet(f"{path}/index")
        first = index.select("buckets").first()
        return Snapshot(index.drop("buckets"), spark.read.parquet(f"{path}/filters"), first["buckets"] if first else 1)


def _grouped(keys: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest; copies are summed up before the shuffle."""
    key = F.xxhash64("digest")
    return (
        keys.groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
        .withColumn("key", key)
        .withColumn("bucket", F.pmod(F.shiftright("key", 20), F.lit(buckets)).cast("int"))
    )


def build_snapshot(keys: DataFrame, buckets: int, rows: int | None = None) -> Snapshot:
    """A snapshot of rows (id, digest), of which there are at most `rows`."""
    index = saved(_grouped(keys, buckets), rows)
    filters = index.select("bucket", "key").groupBy("bucket").applyInPandas(_build_bucket, "bucket int, seed string, segment long, span long, prints binary")
    return Snapshot(index, filters, buckets)


def match_batch(batch: DataFrame, snapshot: Snapshot, rows: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size) over the snapshot and a batch of rows (id, digest)."""
    new = _grouped(batch, snapshot.buckets)
    asked = new.select("bucket", "key", "digest")
    positive = asked.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(_screen_bucket, asked.schema)
    hits = saved(positive.select("digest").join(snapshot.index.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n")), "digest"), rows)
    fresh = (
        new.join(hits, "digest", "left")
        .select("digest", F.least("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"))
    )
    untouched = snapshot.index.join(hits.select("digest"), "digest", "left_anti").select("digest", "keep_id", F.col("n").alias("group_size"))
    return fresh.unionByName(untouched)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.unhex(F.sha2(text, 256)), old=None) -> DataFrame:
    """(id, row, digest, keep_id, group_size, kept), one row per document.

    `digest` maps the normalised text to a binary column; a weak one costs time,
    never correctness, because texts of one digest are compared byte by byte.
    `old` is a condition on `id` that marks the rows of the standing snapshot;
    by default a bit of the id's hash.  `row` is a hash of the text as it is, so
    (id, row) names a document even where ids repeat.

    Ids may be of any type that has an order, may repeat and may be null: of
    equal texts the smallest id stays and null ids only where no other has the
    text.  Rows that repeat id and text are all `kept`: they are one document.
    Null text counts as empty; texts of any length are digested whole; other
    columns, whatever their names, are ignored; an empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), normalised(text).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm")))
    keys = texts.select("id", "row", "digest").checkpoint()
    rows = keys.count()
    old = F.xxhash64("id").bitwiseAND(F.lit(1)) == 0 if old is None else F.coalesce(old, F.lit(False))
    snapshot = build_snapshot(keys.where(old), bucket_count(docs), rows)
    copies = saved(match_batch(keys.where(~old), snapshot, rows).where("group_size > 1").select("digest"), rows)
    held = F.broadcast(copies) if copies.count() <= BROADCAST_DIGESTS else copies
    once = Window.partitionBy("digest")
    classes = (
        texts.join(held, "digest", "left_semi")
        .groupBy("digest", "norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .withColumn("n_texts", F.count("*").over(once))
        .select("digest", "keep_id", "group_size", F.when(F.col("n_texts") > 1, F.col("norm")).alias("norm"))
    )
    classes = saved(classes, rows, 10_000)
    out = keys.join(classes.where("norm is null").drop("norm"), "digest", "left")
    collided = classes.where("norm is not null")
    if collided.select("digest").first() is not None:
        clash = F.broadcast(collided.select("digest").distinct()) if collided.count() <= BROADCAST_DIGESTS else collided.select("digest").distinct()
        own = texts.join(clash, "digest", "left_semi").join(collided, ["digest", "norm"]).select("id", "row", "digest", "keep_id", "group_size")
        out = out.join(collided.select("digest").distinct(), "digest", "left_anti").select("id", "row", "digest", "keep_id", "group_size").unionByName(own)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", "row", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays; a bit of the ids' hashes divides snapshot and new batch."""
    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
