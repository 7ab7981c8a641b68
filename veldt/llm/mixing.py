"""Mixing sources to target weights, by fixed-length blocks.

The words of each source form one stream, cut into blocks of equal length.  The
slots that each source fills in each output shard are a multinomial draw,
conditioned on the sources' totals so that the mix meets its targets.  Slot k of
a source reads the block at place k of a pseudorandom permutation of the
source's block indices; a second epoch uses another permutation.  Blocks are
then joined by (source, index).  No step holds a source in one task: offsets
are two-level prefix sums, and the draws descend a binary tree of shards that
any task can follow by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .session import free_name, prepare, read_table, saved
from .textops import chunks, mix, words

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 4096
SHARDS_PER_TASK = 128
#: The plan holds one row per source on the driver; more sources than this are an error.
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 2_000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_REPEATS = 1.5, 2


def fill_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share `total` by weight; targets stop at cap * size and their excess is reshared among the rest."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, n in enumerate(sizes) if n > 0], min(total, cap * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in full:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(0.0, left)
    return target


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of x under a keyed permutation of range(n): four Feistel rounds, walked until inside."""
    half = max(1, (max(2, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            salt = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            left, right = right, left ^ (mix(right + salt) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def draw_without_replacement(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls are good, from an urn of `good` and `bad` ones, of any number: a hypergeometric draw.

    Rejection from a flat top with exponential tails, which covers every
    log-concave distribution around its mode.  Probabilities are differences of
    log gamma: exact to about 1e-3 of themselves at 10^12 balls.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    log = lambda x: -sum(math.lgamma(v + 1) for v in (x, good - x, draws - x, bad - draws + x))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    every = sum(math.lgamma(v + 1) for v in (good, bad, draws, good + bad - draws)) - math.lgamma(good + bad + 1)
    at_mode = log(mode)
    top = math.exp(min(0.0, every + at_mode))
    width = 1 + top / 2
    while True:
        u, w = rng.random(), rng.random()
        y = rng.random() * width / top if u <= width / (1 + width) else (width + rng.exponential()) / top
        step = int(y + 0.5)
        x = mode + step if rng.random() < 0.5 else mode - step
        if low <= x <= high and w * min(1.0, math.exp(width - top * y)) <= math.exp(log(x) - at_mode):
            return x


def _split(rng: np.random.Generator, totals: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` slots fall to each source, drawn without replacement from its total."""
    out, rest = np.zeros(len(totals), np.int64), int(totals.sum())
    for i, n in enumerate(totals):
        rest -= int(n)
        if n and draws:
            out[i] = draw_without_replacement(rng, int(n), rest, draws)
            draws -= int(out[i])
    return out


def shard_draw(totals: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots per source in one shard, and the slots of each source in the shards before it."""
    before, low, high = np.zeros(len(totals), np.int64), 0, shards
    totals = totals.copy()
    slots = int(totals.sum())
    edge = lambda k: slots * k // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _split(rng, totals, edge(middle) - edge(low))
        if shard < middle:
            totals, high = left, middle
        else:
            before, totals, low = before + left, totals - left, middle
    return totals, before


@dataclass(frozen=True)
class Mix:
    """What a mix is made of.

    Catalyst takes the slots for as small as the range of shards that they are
    drawn from, so joins on them carry a merge hint: they must not be broadcast.

    placed: (id, row, source, rank, size, start) of each document, row being a hash of its text;
    slots: (shard, position, rank, epoch, block); sources: rows of the plan.
    """

    placed: DataFrame
    slots: DataFrame
    segments: DataFrame
    sources: list[dict]


def _placed(ranks: DataFrame, sized: DataFrame, rows: int) -> DataFrame:
    """Word offsets of the documents within their source's stream, by two-level prefix sums; large sources have more buckets."""
    keyed = sized.join(F.broadcast(ranks), F.col("source").eqNullSafe(F.col("r_source"))).withColumn("bucket", F.pmod(F.xxhash64("id", "row"), F.col("buckets")).cast("int"))
    base = (
        keyed.groupBy("rank", "bucket")
        .agg(F.sum("size").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("rank", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    )
    before = Window.partitionBy("rank", "bucket").orderBy("id", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = inner.join(base, ["rank", "bucket"]).select("id", "row", "source", "rank", "size", (F.col("base") + F.col("inner")).alias("start"))
    return saved(placed, rows, 20_000)


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Plan a mix of `share` times all words in which no block repeats more than `max_repeats` times.

    Sources are ordered by code point, null last, and take the weights in turn.
    Null and empty texts have size 0 and are never taken; rows that repeat an id
    or have none are documents of their own; texts of any length are cut into
    blocks whole; other columns, whatever their names, are ignored; an empty
    table gives an empty plan.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    ).checkpoint()
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [int(r["size"]) for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), max_repeats)
    sources = []
    for i, (r, size, target) in enumerate(zip(found, sizes, targets, strict=True)):
        blocks = -(-size // block_words)
        sources.append({"rank": i, "source": r["source"], "size": size, "target": target, "blocks": blocks, "slots": min(max_repeats * blocks, round(target * blocks / size)) if size else 0})
    ranks = spark.createDataFrame([(s["rank"], s["source"], -(-r["rows"] // ROWS_PER_BUCKET)) for s, r in zip(sources, found)], "rank int, r_source string, buckets int")
    placed = _placed(ranks, sized, sum(r["rows"] for r in found))
    totals, blocks = np.array([s["slots"] for s in sources], np.int64), [s["blocks"] for s in sources]
    shards = max(1, -(-int(totals.sum()) // SLOTS_PER_SHARD))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_draw(totals, shards, int(shard), seed)
                rank = np.repeat(np.arange(len(counts)), counts)
                epoch, block = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
                for s in np.flatnonzero(counts):
                    k = before[s] + np.arange(counts[s])
                    own = rank == s
                    epoch[own] = k // blocks[s]
                    place = np.empty(len(k), np.int64)
                    for e in np.unique(k // blocks[s]):
                        on = k // blocks[s] == e
                        place[on] = permute(k[on] % blocks[s], blocks[s], (seed * 1_000_003 + int(s)) * 64 + int(e))
                    block[own] = place
                order = np.random.default_rng([seed, 1, int(shard)]).permutation(len(rank))
                yield pd.DataFrame({"shard": shard, "position": np.arange(len(rank)), "rank": rank[order], "epoch": epoch[order], "block": block[order]})

    tasks = max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-shards // SHARDS_PER_TASK))
    slots = spark.range(0, shards if totals.sum() else 0, 1, tasks).mapInPandas(
        draw, "shard long, position long, rank int, epoch int, block long"
    )
    end, size = F.col("start") + F.col("size"), F.lit(block_words)
    segments = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
        .withColumn("first", F.greatest("start", F.col("block") * size))
        .select("id", "row", "source", "rank", "start", "block", (F.col("first") - F.col("start")).alias("first_word"), (F.least(end, (F.col("block") + 1) * size) - F.col("first")).alias("words"))
    )
    return Mix(placed, slots, segments, sources)


def mixed_shards(plan: Mix) -> DataFrame:
    """The output shards: which words of which document stand at which position."""
    return plan.segments.join(plan.slots.hint("merge"), ["rank", "block"]).select("shard", "position", "epoch", "id", "row", "source", "start", "first_word", "words")


RANGES = "array<struct<first_word:bigint,words:bigint>>"


def mixed_documents(docs: DataFrame, plan: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents cut down to the words that the mix takes, one row for each epoch that takes any.

    A document taken in whole keeps its text; otherwise the ranges taken are
    joined by line breaks.  n_chars, where present, is counted anew.  Documents
    are found again by id, source and text, null or repeated ones too; rows that
    repeat all three share the columns of one of them.
    """
    taken = (
        mixed_shards(plan)
        .groupBy("id", "row", "source", "start", "epoch")
        .agg(F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("ranges"))
        .select("id", "row", "source", "ranges")
    )
    name = free_name(docs, "__row")
    rows = docs.withColumn(name, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    key = [id_col, name, source_col]
    repeated = plan.placed.groupBy("id", "row", "source").count().where("count > 1")
    if repeated.first() is not None:
        rows = rows.dropDuplicates(key)
    on = [rows[a].eqNullSafe(taken[b]) for a, b in zip(key, ("id", "row", "source"))]
    rows = rows.join(taken, on).select(*[rows[c] for c in docs.columns], taken["ranges"].alias(free_name(docs, "__ranges")))
    names = docs.columns
    schema = T.StructType([docs.schema[c] for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch.column(names.index(text_col))):
                start, end, word_at = words(data, at)
                part = batch.slice(first, last - first)
                texts = []
                for i, ranges in enumerate(part.column(len(names)).to_pylist()):
                    pieces, n = [], 0
                    for r in ranges:
                        n += r["words"]
                        if pieces and pieces[-1][1] == r["first_word"]:
                            pieces[-1][1] += r["words"]
                        else:
                            pieces.append([r["first_word"], r["first_word"] + r["words"]])
                    if n == word_at[i + 1] - word_at[i]:
                        texts.append(data[at[i] : at[i + 1]].tobytes().decode())
                    else:
                        texts.append("\n".join(data[start[word_at[i] + a] : end[word_at[i] + b - 1]].tobytes().decode() for a, b in pieces))
                columns = list(part.columns[: len(names)])
                columns[names.index(text_col)] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    columns[names.index("n_chars")] = pa.array([len(t) for t in texts], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, schema)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's size and target."""
    plan = mix_sources(read_table(spark, sf_dir, "documents"))
    counts = plan.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = (
        plan.segments.join(counts.hint("merge"), ["rank", "block"])
        .groupBy(F.col("rank").alias("t_rank"), F.col("start").alias("t_start"))
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    sources = spark.createDataFrame([(s["rank"], s["size"], float(s["target"])) for s in plan.sources], "rank int, source_size long, target double")
    return (
        plan.placed.join(taken, (F.col("rank") == F.col("t_rank")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0), "left")
        .join(F.broadcast(sources), "rank")
        .select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )
