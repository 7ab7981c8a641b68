"""A prefix trie over rebuilt conversations, as tables of nodes.

1. Every turn becomes a key of 16 bytes and a length; texts go no further.
   Turns are dealt to tasks by ranges of (conversation, turn), numbered within
   each task, and a table of at most one row a task tells how many turns of a
   conversation lie in the tasks before.
2. A rebuilt conversation is the head of another one and its own later turns.
   A node's name is the exclusive or of its turns' hashes, each salted with its
   depth: a running sum, taken in blocks of BLOCK turns and carried from block
   to block.  A parent's name is the node's without its last turn.
3. Tasks hold the conversations of one head together and combine their nodes
   before they send them: a partial trie.  Partial tries are merged by name, FAN
   tasks at a time, until one table is left; members are summed, the smallest kept.
4. Conversations that end at a node are a list without bound.  It stays in
   chunks, cut from a global sort, and is hashed chunk after chunk.
5. The rollup goes from the bottom up in doubling steps: after step k a node has
   the sums of the 2^k levels from its own on, and adds those of the nodes 2^k
   levels below.  A node with one member has one path below it, so only shared
   nodes take part.

Every step is a grouped sum, a window over a bounded block or a join; nothing
holds a conversation, a node's members or the trie in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import prepare, read_table, saved, small_side, written

#: Conversations of one head: c has that of c - c % GROUP; heads have HEADS - 1 turns at most.
GROUP, HEADS = 100, 6
#: Turns of a conversation that one window takes.
BLOCK = 4096
#: Tasks whose partial tries meet in one merge.
FAN = 64
#: Conversation ids of a node in one chunk of its list.
CHUNK_IDS = 65_536
NODE, PARENT = ["ka", "kb"], ["qa", "qb"]
NUMBERED = "conv_id long, key binary, size long, part int, at long"
CHUNKS = "ka long, kb long, first long, ids binary"


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, key, size) of every turn that has a conversation; the key stands for role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.length(text).cast("long").alias("size"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place among the rows of its conversation in this task."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
        if conv[0] == last:
            at[: starts[1] if len(starts) > 1 else None] += before
        last, before = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "key", "size")), pa.array(np.full(len(conv), part, np.int32)), pa.array(at)], names=["conv_id", "key", "size", "part", "at"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, size): every turn with its place in its conversation, from 0."""
    order = ["conv_id", F.asc_nulls_first("turn"), "key"]
    placed = written(written(turn_keys(turns)).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, NUMBERED))
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # only the first conversation of a task can have turns in the tasks before: one row a task at most
    carried = saved(sizes.withColumn("before", before).where("before is not null").select("conv_id", "part", "before"))
    placed = placed.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, group, depth, key, size): the turns of rebuilt conversations, and one of depth 0 for each conversation."""
    # stored before the join, so that one conversation with very many turns can be split
    turns = written(numbered_turns(turns).withColumn("group", F.col("conv_id") - F.col("conv_id") % GROUP))
    turn = F.struct("pos", "key", "size")
    heads = turns.where(f"conv_id = group and pos < {HEADS - 1}").groupBy("group").agg(F.sort_array(F.collect_list(turn)).alias("head"))
    heads = saved(heads)
    rows = turns.join(small_side(heads, heads.count(), 300), "group", "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    rows = rows.select("conv_id", "group", "pos", "key", "size", h.alias("h"), F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,key:binary,size:bigint>>")), F.lit(1), h).alias("head"))
    item = lambda depth, key, size: F.struct(depth.cast("long").alias("depth"), key.alias("key"), size.alias("size"))
    root = F.array(item(F.lit(0), F.lit(b""), F.lit(0).cast("long")))
    none = F.array().cast("array<struct<depth:bigint,key:binary,size:bigint>>")
    lead = F.concat(root, F.transform("head", lambda t: item(t["pos"] + 1, t["key"], t["size"])))
    own = F.array(item(F.size("head") + F.col("pos") - F.col("h") + 1, F.col("key"), F.col("size")))
    items = F.concat(F.when(F.col("pos") == 0, lead).otherwise(none), F.when(F.col("pos") >= F.col("h"), own).otherwise(none))
    return rows.select("conv_id", "group", F.explode(items).alias("t")).select("conv_id", "group", "t.*")


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, size, slice, ka, kb, qa, qb): the node of every prefix and its parent; slice is the task's number."""
    root = F.col("depth") == 0
    rows = rows.select(
        "conv_id", "group", "depth", "size", F.floor(F.col("depth") / block).alias("block"),
        F.when(root, F.lit(0).cast("long")).otherwise(F.xxhash64("key", "depth")).alias("a"), F.when(root, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", "key", F.lit(1))).alias("b"),
    )
    so_far = Window.partitionBy("group", "block", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.repartition("group", "block").withColumns({"pa": F.bit_xor("a").over(so_far), "pb": F.bit_xor("b").over(so_far), "slice": F.spark_partition_id()})
    dealt = written(dealt)
    # the last row of a full block holds the block's sum
    full = dealt.where(F.col("depth") % block == block - 1)
    through = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = saved(full.select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("pa").over(through).alias("ca"), F.bit_xor("pb").over(through).alias("cb")))
    n = carry.count()
    if n:
        dealt = dealt.join(small_side(carry, n), ["conv_id", "block"], "left").withColumns({"pa": F.col("pa").bitwiseXOR(F.coalesce("ca", F.lit(0))), "pb": F.col("pb").bitwiseXOR(F.coalesce("cb", F.lit(0)))})
    up = lambda p, t: F.when(~root, F.col(p).bitwiseXOR(F.col(t)))
    return dealt.select("conv_id", "depth", "size", "slice", F.col("pa").alias("ka"), F.col("pb").alias("kb"), up("pa", "a").alias("qa"), up("pb", "b").alias("qb"))


def merged(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(ka, kb, qa, qb, depth, size, conv_id, n_convs): the nodes of all tasks' partial tries."""
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = rows.withColumn("n_convs", F.lit(1).cast("long"))
    held = [F.min(c).alias(c) for c in (*PARENT, "depth", "size", "conv_id")] + [F.sum("n_convs").alias("n_convs")]
    while slices > fan:
        table = table.groupBy(*NODE, F.floor(F.col("slice") / fan).alias("slice")).agg(*held)
        slices = -(-slices // fan)
    return table.groupBy(*NODE).agg(*held)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (ka, kb, conv_id) as chunks of joined decimal numbers."""
    for batch in batches:
        a, b, conv = (batch.column(c).to_numpy() for c in ("ka", "kb", "conv_id"))
        edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        ids = [",".join(map(str, conv[i:j].tolist())).encode() for i, j in zip(edges, np.r_[edges[1:], len(a)])]
        yield pa.RecordBatch.from_arrays([pa.array(a[edges]), pa.array(b[edges]), pa.array(conv[edges]), pa.array(ids, pa.binary())], names=["ka", "kb", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, ends_sha256) of sorted chunks, one chunk at a time."""
    names, node, digest = ["ka", "kb", "ends_sha256"], None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(batch.column("ka").to_pylist(), batch.column("kb").to_pylist(), batch.column("ids").to_pylist()):
            if (a, b) == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (a, b), hashlib.sha256()
            digest.update(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=names)


def end_digests(rows: DataFrame) -> DataFrame:
    """(ka, kb, ends_sha256) of every node at which a conversation ends."""
    spark = rows.sparkSession
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *NODE)).alias("e")).select("conv_id", "e.ka", "e.kb")
    last = written(last).repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = written(last.mapInArrow(_chunks, CHUNKS))
    held = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(held, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, "ka long, kb long, ends_sha256 string")


def rolled_up(shared: DataFrame, deepest: int) -> DataFrame:
    """(ka, kb, n_leaves, saved_tokens) of nodes (ka, kb, qa, qb, depth, n_leaves, saved_tokens), summed over their subtrees."""
    state, step = shared, 1
    while step <= deepest:
        gain = state.where("qa is not null").groupBy(F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("saved"))
        # a node's next pointer is 2 * step levels up, if it lies so deep; what points at the root asks no more
        jump = state.where("qa is not null").select(F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("qa").alias("ja"), F.col("qb").alias("jb"))
        deep = F.col("depth") >= 2 * step
        plain = [*NODE, "depth", (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens")]
        summed = state.join(gain, NODE, "left")
        low = summed.where(~deep).select(*plain, F.lit(None).cast("long").alias("qa"), F.lit(None).cast("long").alias("qb"))
        high = summed.where(deep).select(*plain, *PARENT).join(jump, PARENT).drop(*PARENT).withColumnsRenamed({"ja": "qa", "jb": "qb"})
        state = low.unionByName(high).checkpoint()
        step *= 2
    return state.select(*NODE, "n_leaves", "saved_tokens")


def conversation_trie(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    `turns` has conv_id, turn, role and text.  A null role or text is empty; a
    null turn comes first; turns of equal number are ordered by the md5 of their
    role and text, and equal ones count each.  Turns without a conversation id
    belong to no conversation and take no part.  Texts of any length are hashed
    whole; other columns, whatever their names, are ignored; an empty table has
    no conversation and gives no node.
    """
    spark = prepare(turns.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNK_IDS))
    try:
        rows = written(prefixes(rebuilt(turns), block))
        nodes = written(merged(rows, fan))
        ends = written(end_digests(rows))
    finally:
        prepare(spark)
    below = nodes.where("depth > 0").groupBy(F.col("qa").alias("ka"), F.col("qb").alias("kb")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    shared = nodes.where("n_convs > 1").join(below, NODE, "left")
    own = F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("alone")).cast("long")
    shared = shared.select(*NODE, *PARENT, "depth", F.col("conv_id").alias("least"), F.coalesce("n_children", F.lit(0)).alias("n_children"), own.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")).checkpoint()
    facts = shared.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest")).first()
    sums = rolled_up(shared.drop("least", "n_children"), facts["deepest"]).join(shared.select(*NODE, "n_children"), NODE).checkpoint()
    parents = shared.select(F.col("ka").alias("qa"), F.col("kb").alias("qb"), "least")
    out = nodes.join(small_side(sums, facts["n"], 48), NODE, "left").join(small_side(parents, facts["n"], 32), PARENT, "left").join(ends, NODE, "left")
    one_path = F.when(F.col("ends_sha256").isNull(), 1).otherwise(0)  # of a node with one member
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("least", "conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", one_path).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over rebuilt conversations."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH k AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM k),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 6 AS h FROM t),
r AS (
  SELECT c.conv_id, 0 AS own, pos, key, size FROM c JOIN t ON t.conv_id = c.head WHERE pos < h
  UNION ALL SELECT c.conv_id, 1, pos, key, size FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth, size, string_agg(key, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM d GROUP BY conv_id),
a AS (
  SELECT path, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM d GROUP BY path),
z AS (
  SELECT path, string_agg(CAST(d.conv_id AS VARCHAR), ',' ORDER BY d.conv_id) AS ends FROM d JOIN e USING (conv_id, depth) GROUP BY path),
u AS (SELECT p.path AS path, count(*) AS n_children FROM a p JOIN a x ON x.depth = p.depth + 1 AND left(x.path, 32 * p.depth) = p.path GROUP BY 1),
s AS (
  SELECT v, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM (SELECT DISTINCT x.path AS v, y.path AS path FROM d x JOIN d y ON x.conv_id = y.conv_id AND x.depth <= y.depth) JOIN a USING (path) LEFT JOIN u USING (path) GROUP BY v)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM a JOIN s ON s.v = a.path LEFT JOIN a p ON a.depth > 0 AND p.path = left(a.path, 32 * (a.depth - 1)) LEFT JOIN u ON u.path = a.path LEFT JOIN z ON z.path = a.path
"""
