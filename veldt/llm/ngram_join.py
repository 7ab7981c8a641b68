"""N-gram Jaccard join with a prefix trie over globally ordered shingle sets.

1. Every text becomes its set of distinct 5-word shingles.  Equal sets are one
   set from here on: a task sends a set once however many copies it reads.
2. Shingles are exchanged by hash, in packed runs, to learn in how many sets
   each occurs.  Only shingles of two sets or more can overlap; they go back to
   their sets.  A set with too few of them can have no partner and leaves.
3. The rest are ordered by (number of sets, hash), rarest first: the global
   order.  By the prefix filter, linked sets share a shingle within the first
   n - ceil(t n) + 1.  Sets that share one are put in the same block, by
   connected components over star edges to each shingle's smallest set.
4. In each block the ordered sets are stored in a trie.  Each set walks it with
   the overlap so far; a subtree is left when the rest of the set and of the
   subtree cannot reach the required overlap, when its sizes are out of range,
   or when it holds no set that shares a prefix shingle and is outside the
   walker's component.
5. Of a block of more than CELL_TOKENS shingles a few sets, picked by a hash,
   are leaders.  Every set is compared with these, wherever it lies.  Sets that
   link to one leader are a group, groups that share a set are one group, and a
   set that links to no leader is a group alone.  Within a group all is joined.
   Linked sets of two groups are not both in the largest one, so every set
   outside the largest group of its block is compared with all of the block, in
   cells, which hold a part of either side: a family of very many near copies
   never meets in one task.  Links of all cells are joined by components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .exchange import RUNS, RUNS_ARROW, RunSender, received
from .session import bucket_count, prepare, read_table, saved, small_side
from .textops import LOWER, chunks, distinct_sorted, mix, release_memory, shingles, span_hashes, words

SHINGLE = 5
#: Jaccard threshold in percent, compared in whole numbers.
PERCENT = 75
#: Shingles of one trie at most: both sides of a cell have half of this.
BLOCK_TOKENS = 4_000_000
#: Blocks of more shingles are compared with leaders first; what is left goes into cells of about so many.
CELL_TOKENS = 65_536
LEADERS = 4
#: Names of sets that a task remembers having sent; one sent again is found equal where it arrives.
REMEMBERED = 1_000_000
#: Sets that a task puts in order or solves before its results are stored.
SETS_PER_TASK = 4_000


def need(total: int, percent: int) -> int:
    """The least overlap of two sets of together `total` shingles: 100 o >= percent (total - o)."""
    return -(-percent * total // (100 + percent))


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk, A-Z lower-cased."""
    data = LOWER[data]
    start, end, word_at = words(data, at)
    hashes, sh_at = shingles(span_hashes(data, start, end), word_at, k)
    return [distinct_sorted(hashes[a:b]) for a, b in zip(sh_at[:-1], sh_at[1:])]


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names, the empty set has 0."""
    out = np.zeros(len(sets), np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.r_[0, np.cumsum(n[full])[:-1]]
        total = np.add.reduceat(mix(np.concatenate([sets[i] for i in full]) + np.uint64(0xA5)), at)
        out[full] = np.maximum(mix(total + n[full].astype(np.uint64)), np.uint64(1))
    return out


def _sets_of(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, row, n, sid) of every document."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("row", "n", "sid")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch.column(2)):
                sets = shingle_sets(data, at, k)
                n = pa.array([len(s) for s in sets], pa.int64())
                own = [batch.column(i).slice(first, last - first) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, n, pa.array(set_ids(sets).view(np.int64))], names=schema.names)

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text")).mapInArrow(run, schema)


def _sent(docs: DataFrame, text_col: str, k: int, buckets: int) -> DataFrame:
    """Runs of every set's shingles by bucket; a task sends equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, seen = RunSender(buckets), set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            for _, _, data, at in chunks(batch.column(0)):
                sets = shingle_sets(data, at, k)
                names = set_ids(sets)
                fresh = []
                for i, name in enumerate(names.tolist()):
                    if name and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                if fresh:
                    n = np.array([len(sets[i]) for i in fresh], np.uint32)
                    sender.add(names[fresh], n, n, np.concatenate([sets[i] for i in fresh]))
                if sender.full():
                    yield pa.RecordBatch.from_pylist(list(sender.flush()), RUNS_ARROW)
        rows = list(sender.flush())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RUNS_ARROW)
        release_memory()

    return docs.select(text_col).mapInArrow(run, RUNS)


SHARED = RUNS + ", extra binary"
SHARED_ARROW = RUNS_ARROW.append(pa.field("extra", pa.binary()))


def _count_bucket(parts: int):
    """Keep the shingles of a bucket that occur in two sets or more, with that number, and send them back by set."""

    def run(table: pa.Table) -> pa.Table:
        owner, total, count, keys = received(table, {"owner": np.uint64, "total": np.uint32, "count": np.uint32, "keys": np.uint64})
        # the same set from several tasks carries the same keys: the first run stays
        _, first = np.unique(owner, return_index=True)
        stays = np.zeros(len(owner), bool)
        stays[first] = True
        run_of = np.repeat(np.arange(len(owner)), count)
        on = stays[run_of]
        run_of, keys = run_of[on], keys[on]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
        size = np.diff(np.r_[edge, len(ranked)])
        in_sets = np.empty(len(keys), np.uint32)
        in_sets[order] = np.repeat(size, size).astype(np.uint32)
        shared = in_sets > 1
        run_of, keys, in_sets = run_of[shared], keys[shared], in_sets[shared]
        sender = RunSender(parts)
        if len(keys):
            own, n = np.unique(run_of, return_counts=True)
            sender.add(owner[own], total[own], n, keys, in_sets)
        return pa.Table.from_pylist(list(sender.flush(lambda names: (mix(names) % np.uint64(parts)).astype(np.int32))), SHARED_ARROW)

    return run


ORDERED = "sid long, n long, tokens binary, prefix array<long>"
ORDERED_ARROW = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _order_part(percent: int):
    """Put the shared shingles of each set in global order and cut its prefix; sets that cannot reach the threshold go."""

    def run(table: pa.Table) -> pa.Table:
        owner, total, count, keys, in_sets = received(table, {"owner": np.uint64, "total": np.uint32, "count": np.uint32, "keys": np.uint64, "extra": np.uint32})
        names, at, which = np.unique(owner, return_index=True, return_inverse=True)
        held = np.bincount(which, weights=count, minlength=len(names)).astype(np.int64)
        n = total[at].astype(np.int64)
        least = -(-percent * n // 100)
        stays = held >= least
        of = which[np.repeat(np.arange(len(owner)), count)]
        on = stays[of]
        of, keys, in_sets = of[on], keys[on], in_sets[on]
        order = np.lexsort((keys, in_sets, of))
        of, keys, in_sets = of[order], keys[order], in_sets[order]
        rows = []
        for i in np.flatnonzero(stays):
            a, b = np.searchsorted(of, i), np.searchsorted(of, i, "right")
            alone = int(n[i]) - (b - a)  # shingles of no other set come first in the order
            prefix = int(n[i] - least[i] + 1) - alone
            rows.append({"sid": int(names[i].view(np.int64)), "n": int(n[i]), "tokens": keys[a:b].tobytes(), "prefix": keys[a : a + prefix].view(np.int64)})
        return pa.Table.from_pylist(rows, ORDERED_ARROW)

    return run


class Trie:
    """A radix trie over sets of ranks, each in rising order.

    Sets are sorted as sequences; a node is a range of them with a common run of
    ranks.  Besides its run a node keeps the smallest and largest full size and
    the longest remainder of its sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        n = len(sets)
        common = np.zeros(n + 1, np.int64)
        for i in range(1, n):
            m = min(len(sets[i - 1]), len(sets[i]))
            differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
            common[i] = differ[0] if len(differ) else m
        self.low, self.high, self.begin, self.end, self.children = [], [], [], [], []
        self._grow(0, n, 0, common)
        self.min_n = [int(sizes[a:b].min()) for a, b in zip(self.low, self.high)]
        self.max_n = [int(sizes[a:b].max()) for a, b in zip(self.low, self.high)]
        lengths = np.array([len(s) for s in sets])
        self.rest = [int(lengths[a:b].max()) - e for a, b, e in zip(self.low, self.high, self.end)]
        for own in self.children:
            own.sort(key=lambda c: self.low[c])
        self.child_lows = [np.array([self.low[c] for c in own], np.int64) for own in self.children]

    def _grow(self, low: int, high: int, depth: int, common: np.ndarray) -> None:
        todo = [(low, high, depth, -1)]
        while todo:
            a, b, depth, parent = todo.pop()
            end = int(common[a + 1 : b].min()) if b - a > 1 else len(self.sets[a])
            node = len(self.low)
            self.low.append(a)
            self.high.append(b)
            self.begin.append(depth)
            self.end.append(end)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > 1:
                at = [a, *(a + 1 + np.flatnonzero(common[a + 1 : b] == end)).tolist(), b]
                for x, y in zip(at, at[1:]):
                    if y - x > 1 or len(self.sets[x]) > end:
                        todo.append((x, y, end, node))

    def ending(self, node: int) -> range:
        """Sets that end at this node: sorted first among the node's sets."""
        a, end = self.low[node], self.end[node]
        b = a
        while b < self.high[node] and len(self.sets[b]) == end:
            b += 1
        return range(a, b)

    def walk(self, ranks: np.ndarray, size: int, percent: int, wanted: np.ndarray, found) -> None:
        """Call found(i) for every set i of the sorted places `wanted` that is linked with the set `ranks` of full size `size`.

        Subtrees without a wanted set are never entered.
        """
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            a, b = self.low[node], self.high[node]
            x, y = np.searchsorted(wanted, (a, b))
            if x == y or self.max_n[node] * 100 < percent * size or self.min_n[node] * percent > 100 * size:
                continue
            run = self.sets[a][self.begin[node] : self.end[node]]
            left = len(ranks)
            if len(run):
                place = np.searchsorted(ranks, run)
                overlap += int((ranks[np.minimum(place, len(ranks) - 1)] == run).sum())
                left = len(ranks) - int(np.searchsorted(ranks, run[-1], "right"))
            if overlap + min(left, self.rest[node]) < need(size + self.min_n[node], percent):
                continue
            ending = self.ending(node)
            for i in wanted[x : np.searchsorted(wanted, ending.stop)]:
                if overlap >= need(size + int(self.sizes[i]), percent):
                    found(int(i))
            children = self.children[node]
            if len(children):
                lows = self.child_lows[node]
                at = np.searchsorted(lows, wanted[np.searchsorted(wanted, ending.stop) : y], "right") - 1
                todo.extend((children[c], overlap) for c in np.unique(at))


def link_block(sids: list[int], sizes: list[int], tokens: list[np.ndarray], percent: int, group: list[int] | None = None, probe: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links (sid, sid) that join the sets of a block which are linked, as far as they are not joined yet.

    The block's order is by the number of its sets that hold a shingle, rarest
    first, then by hash.  A set looks only for sets that share a shingle of its
    and their prefix and are not joined with it yet; the trie decides on all of
    these in one walk.  Sets of one `group` are joined from the start; only sets
    of `probe`, by default all, look for others.
    """
    at = np.r_[0, np.cumsum([len(t) for t in tokens])]
    known, which, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, counts))] = np.arange(len(known))
    ranks = rank[which].astype(np.uint32)
    sets = [np.sort(ranks[a:b]) for a, b in zip(at, at[1:])]
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    sets, names = [sets[i] for i in order], np.array([sids[i] for i in order], np.int64)
    size = np.array([sizes[i] for i in order], np.int64)
    label = np.arange(len(sets)) if group is None else np.unique(np.array(group, np.int64)[order], return_inverse=True)[1]
    looks = np.ones(len(sets), bool) if probe is None else np.array(probe, bool)[order]
    trie = Trie(sets, size)

    # sets by the shingles of their prefixes
    prefix = np.array([max(0, len(s) - -(-percent * int(n) // 100) + 1) for s, n in zip(sets, size)])
    holder = np.repeat(np.arange(len(sets)), prefix)
    held = np.concatenate([s[:p] for s, p in zip(sets, prefix)]) if len(sets) else np.zeros(0, np.uint32)
    by = np.lexsort((holder, held))
    holder, held = holder[by], held[by]
    rest = np.array([len(s) for s in sets]) - prefix
    edge = np.array([int(s[p - 1]) if p else -1 for s, p in zip(sets, prefix)])
    links = []

    for x in np.flatnonzero(looks):
        own = sets[x][: prefix[x]]
        low, high = np.searchsorted(held, own), np.searchsorted(held, own, "right")
        near = np.concatenate([holder[a:b] for a, b in zip(low, high) if b - a > 1] or [holder[:0]])
        near = near[label[near] != label[x]]

        def found(i: int) -> None:
            if label[i] != label[x]:
                links.append((int(names[x]), int(names[i])))
                label[label == label[i]] = label[x]

        if not len(near):
            continue
        # up to the smaller of the two prefixes' ends sets share what their prefixes share; beyond, at most what is left of that set
        near, shared = np.unique(near, return_counts=True)
        bound = shared + np.where(edge[x] <= edge[near], rest[x], rest[near])
        near = near[bound >= -(-percent * (size[x] + size[near]) // (100 + percent))]
        if len(near):
            trie.walk(sets[x], int(size[x]), percent, near, found)
    return links


def _roots(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(sid, root) of links that join sets one by one; root is the smallest sid of its component."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(up)]


def _solve(percent: int):
    """Rows sorted by (block, cell) become the links of each cell; those of a whole block as (sid, root)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None

        def links() -> list[tuple]:
            if len(held) < 2:
                return []
            whole = bool(held[0].whole)
            found = link_block([r.sid for r in held], [r.n for r in held], [np.frombuffer(r.tokens, np.uint64) for r in held], percent, [r.group for r in held], [r.probe for r in held])
            return [(*pair, whole) for pair in (_roots(found) if whole else found)]

        for batch in batches:
            out = []
            for r in batch.itertuples():
                if (r.block, r.cell) != key:
                    out += links()
                    held, key = [], (r.block, r.cell)
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=["sid", "root", "whole"])
        out = links()
        if out:
            yield pd.DataFrame(out, columns=["sid", "root", "whole"])
        held = []
        release_memory()

    return run


MET = "block long, sid long, w long, found array<long>"


def _meet(percent: int):
    """(block, sid, w, found): which leaders of its block a set links to, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for batch in batches:
            found = []
            for i, (block, n) in enumerate(zip(batch.column("block").to_pylist(), batch.column("n").to_pylist())):
                if block not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[block] = [(r["sid"], r["n"], np.sort(np.frombuffer(r["tokens"], np.uint64))) for r in batch.column("leaders")[i].as_py()]
                own = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                links = []
                for sid, m, tokens in known[block]:
                    if len(own) and len(tokens):
                        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                        if int((tokens[at] == own).sum()) >= need(n + m, percent):
                            links.append(sid)
                found.append(links)
            w = pc.binary_length(batch.column("tokens")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("sid"), w, pa.array(found, pa.list_(pa.int64()))], names=["block", "sid", "w", "found"])

    return run


def _met_leaders(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (block, sid) of large blocks with their size in bytes and the leaders that they link to."""
    h = F.xxhash64("sid")
    firsts = [F.min(F.when(F.pmod(h, F.lit(LEADERS)) == k, F.struct(h.alias("h"), "sid"))) for k in range(LEADERS)]
    picked = hot.groupBy("block").agg(F.array_compact(F.array(*firsts)).alias("l")).select("block", F.explode("l.sid").alias("sid"))
    leaders = picked.join(sets, "sid").groupBy("block").agg(F.collect_list(F.struct("sid", "n", "tokens")).alias("leaders"))
    leaders = saved(leaders)
    size = leaders.agg(F.coalesce(F.sum(F.aggregate("leaders", F.lit(0), lambda a, s: a + F.length(s["tokens"]) + 24)), F.lit(0)).alias("b")).first()["b"]
    return saved(hot.join(sets, "sid").join(small_side(leaders, size, 1), "block").select("block", "sid", "n", "tokens", "leaders").mapInArrow(_meet(percent), MET))


def _grouped_leaders(met: DataFrame) -> DataFrame:
    """(block, leader, group): which leaders of a block are joined by sets that link to several; at most LEADERS rows a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(block, *pair) for block, kinds in zip(batch["block"], batch["kinds"]) for pair in _roots([(int(k[0]), int(x)) for k in kinds for x in k])]
            yield pd.DataFrame(rows, columns=["block", "leader", "group"])

    kinds = met.where(F.size("found") > 0).groupBy("block").agg(F.collect_set("found").alias("kinds"))
    return kinds.mapInPandas(run, "block long, leader long, group long")


def solve_blocks(blocks: DataFrame | None, sets: DataFrame, tasks: int, percent: int, block_tokens: int = BLOCK_TOKENS, rows: int | None = None) -> DataFrame:
    """(sid, root) of linked sets, given blocks (sid, block) outside of which no set has a link, and sets (sid, n, tokens).

    A set may be in several blocks; its roots then have to be joined by
    components.  Sets that name their one block themselves (sid, n, tokens,
    block) need no `blocks`; one of them may occur more than once.
    """
    cell_tokens = min(CELL_TOKENS, block_tokens)
    weight = (F.length("tokens") / 8).cast("long")
    named, sets = (sets, sets.drop("block")) if blocks is None else (None, sets)
    weighed = named.select("block", weight.alias("w")) if blocks is None else blocks.join(sets.select("sid", weight.alias("w")), "sid")
    blocks = named.select("sid", "block") if blocks is None else blocks
    large = weighed.groupBy("block").agg(F.sum("w").alias("w")).where(F.col("w") > cell_tokens).select("block")
    large = saved(large, rows)
    n_large = large.count()
    every = blocks if named is None else named
    whole = every.join(small_side(large, n_large), "block", "left_anti") if n_large else every
    if named is None:
        whole = whole.join(sets, "sid")
    columns = ["block", "cell", "whole", "probe", "group", "sid", "n", "tokens"]
    ready = whole.select("block", F.lit("").alias("cell"), F.lit(True).alias("whole"), F.lit(True).alias("probe"), F.col("sid").alias("group"), "sid", "n", "tokens")
    if n_large:
        met = _met_leaders(blocks.join(small_side(large, n_large), "block", "left_semi"), sets, percent)
        leaders = saved(_grouped_leaders(met).withColumnRenamed("group", "joined"), rows)
        first = met.withColumn("leader", F.array_min("found")).join(small_side(leaders, LEADERS * n_large), ["block", "leader"], "left")
        open_ = saved(first.select("block", "sid", "w", F.coalesce("joined", "sid").alias("group")), rows)
        sizes = open_.groupBy("block", "group").agg(F.sum("w").alias("w"))
        parts = sizes.groupBy("block").agg(F.max(F.struct("w", "group")).alias("most"), F.sum("w").alias("all")).withColumn("left", F.col("all") - F.col("most.w")).where("left > 0")
        half = F.lit(4 * block_tokens)  # of bytes
        side = F.least(F.greatest(F.col("left"), F.lit(8 * cell_tokens)), half)
        parts = saved(parts.select("block", F.col("most.group").alias("largest"), F.ceil(F.col("left") / half).cast("int").alias("p"), F.ceil(F.col("all") / side).cast("int").alias("q")), rows)
        # stored before the join, so that a block with very many sets can be split
        open_ = open_.join(small_side(parts, n_large), "block").withColumn("probe", F.col("group") != F.col("largest"))
        open_ = open_.withColumn("i", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("p"))).withColumn("j", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("q")))
        look = open_.where("probe").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        look = look.select("block", F.concat_ws("-", "i", "to").alias("cell"), F.lit(False).alias("whole"), "probe", "group", "sid")
        seen = open_.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).where("not probe or to <> i")
        seen = seen.select("block", F.concat_ws("-", "to", "j").alias("cell"), F.lit(False).alias("whole"), F.lit(False).alias("probe"), "group", "sid")
        ready = ready.unionByName(look.unionByName(seen).join(sets, "sid").select(*columns))
    links = (
        ready.repartition(tasks, "block", "cell")
        .sortWithinPartitions("block", "cell", "sid")
        .mapInPandas(_solve(percent), "sid long, root long, whole boolean")
    )
    links = saved(links, rows, SETS_PER_TASK)
    done = links.where("whole").select("sid", "root")
    if not n_large:
        return done
    rest = links.where(~F.col("whole")).select("sid", "root").unionByName(met.select("sid", F.explode("found").alias("root")).where("sid <> root"))
    return done.unionByName(connected_components(rest, "sid", "root", rows).select(F.col("node").alias("sid"), F.col("component").alias("root")))


def set_components(docs: DataFrame, rows: int, text_col: str, k: int, percent: int, block_tokens: int) -> DataFrame:
    """(sid, root) of every set that is linked to another set, for documents of so many rows."""
    buckets = bucket_count(docs)
    sent = _sent(docs, text_col, k, buckets)
    shared = sent.groupBy("bucket").applyInArrow(_count_bucket(buckets), SHARED)
    ordered = saved(shared.groupBy("bucket").applyInArrow(_order_part(percent), ORDERED), rows, SETS_PER_TASK)
    postings = ordered.select("sid", F.explode("prefix").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("sid").alias("leader"), F.max("sid").alias("other")).where("leader <> other").select("token", "leader")
    edges = postings.join(leaders, "token").where("sid <> leader").select("sid", "leader")
    blocks = connected_components(edges, "sid", "leader", rows).select(F.col("node").alias("sid"), F.col("component").alias("block"))
    return solve_blocks(blocks, ordered.select("sid", "n", "tokens"), buckets, percent, block_tokens, rows)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, row, n_shingles, set_id, component_id, root, group_size, kept), one row per document.

    Documents link when the Jaccard similarity of their shingle sets is at least
    `percent` hundredths; component_id is the smallest id reached, `root` a
    number of the component, group_size its documents and kept whether id is
    component_id.  `row` is a hash of the text, so (id, row) names a document
    even where ids repeat.  Texts without words, empty and null texts have no
    shingles and no link.  Null ids are never the smallest unless a component
    has no other.  Rows repeated in full are documents with equal sets; texts of
    any length are cut into shingles whole; other columns, whatever their names,
    are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sets = _sets_of(docs, id_col, text_col, k)
    rows = docs.count()
    roots = set_components(docs, rows, text_col, k, percent, block_tokens)
    # a set without shingles has no name; its documents get no root and are their own component
    named = sets.withColumn("sid", F.when(F.col("n") > 0, F.col("sid")))
    joined = named.join(small_side(roots, roots.count(), 16), "sid", "left").select("id", "row", "n", "sid", F.coalesce("root", "sid").alias("root")).checkpoint()
    lowest = joined.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    # stored before the join, so that a component with very many documents can be split
    lowest = saved(lowest, rows)
    out = joined.join(small_side(lowest, lowest.count(), 64), "root", "left")
    component = F.when(F.col("members").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        "id", "row", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), component.alias("component_id"), "root",
        F.coalesce("members", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    out = ngram_join(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2)::BIGINT)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
