"""A fitted and stored vector index: cells by k-means over all rows, and a navigable graph in every block of a cell.

Build, save, load and search are separate calls.  A block is one row: the ids of
at most BLOCK items of a cell, their vectors as one matrix, and the links of each
to near items.  A search sends queries, packed, to the blocks of their nearest
cells; a task scores a block either whole, as a matrix product, or by walking
its graph for all queries of a package at once.

A beam that is enough for few items misses many of more, so an index with graphs
keeps the beam that its walks need, measured against exact neighbours.

What the driver holds are the centres (at most MAX_CELLS vectors); items,
blocks, queries and results stay in tables.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import doubles
from ..sources import io
from ..sources.session import stored
from .matrices import matrix_of

METRICS = ("ip", "l2")
#: Items of a block at most, about; a cell of more has several, dealt by a hash of the id.
BLOCK = 16_384
#: Links that an item gets to others, and with those that others have to it.
LINKS = 8
#: Queries that travel to a block in one row.
QUERY_PACKAGE = 1024
#: A graph's walks are at least as wide as it takes to find this share of the FIT_K best items of FIT_ITEMS items.
FIT_RECALL, FIT_K, FIT_ITEMS = 0.94, 10, 256
FIT_BEAMS = [round(16 * 2 ** (i / 2)) for i in range(11)]  # 16 to 512
MAX_CELLS = 65_536


def cell_count(items: int, each: int = BLOCK // 2) -> int:
    """Cells for so many items, about `each` in one: a block is what a walk is worth the most for."""
    return min(MAX_CELLS, max(1, -(-items // each)))


def _nearest(v: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each vector, nearest first, equal ones by number."""
    out = np.empty((len(v), n), np.int32)
    half = (centres**2).sum(1) / 2
    for lo in range(0, len(v), 1024):
        s = half[None] - v[lo : lo + 1024] @ centres.T
        if n == 1:
            out[lo : lo + 1024, 0] = s.argmin(1)
        else:
            out[lo : lo + 1024] = np.argsort(s, axis=1, kind="stable")[:, :n]
    return out


def _clean(items: DataFrame, item_id: str, vector: str) -> DataFrame:
    return items.where(F.col(item_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(item_id).alias("id"), doubles(F.col(vector)).alias("v"))


def fit_cells(items: DataFrame, cells: int, item_id: str = "item_id", vector: str = "embedding", rounds: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Centres (cells, width) by k-means over all rows; a round is one pass with one partial sum per task and cell.

    The first centres are the vectors of the ids with the least hashes.  A cell
    that lost all its items keeps its centre.  Equal inputs give equal centres
    up to the order of sums.
    """
    if not 0 < cells <= MAX_CELLS:
        raise ValueError(f"between 1 and {MAX_CELLS} cells, not {cells}")
    rows = _clean(items, item_id, vector)
    first = rows.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(cells).select("v").toPandas()
    if first.empty:
        raise ValueError("no vectors to fit cells on")
    centres = np.unique(np.stack(first["v"].to_numpy()), axis=0)

    for _ in range(rounds):
        held = centres  # bound for this round's tasks

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(held), np.zeros(len(held), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = matrix_of(batch.column(0))
                    near = _nearest(v, held)[:, 0]
                    np.add.at(total, near, v)
                    n += np.bincount(near, minlength=len(held))
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[on]), pa.array(list(total[on]), pa.list_(pa.float64()))], names=["cell", "n", "total"])

        parts = rows.select("v").mapInArrow(sums, "cell int, n long, total array<double>")
        width = centres.shape[1]
        found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total")).toPandas()
        new = centres.copy()
        new[found["cell"]] = np.stack(found["total"].to_numpy()) / found["n"].to_numpy()[:, None]
        moved = float(np.abs(new - centres).max())
        centres = new
        if moved < tolerance:
            break
    return centres


# --- the graph of a block -------------------------------------------------------------


def _similar(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of all rows of a with all rows of b, larger is nearer."""
    s = a @ b.T
    return s if metric == "ip" else 2 * s - (b**2).sum(1)[None] - (a**2).sum(1)[:, None]


def linked(v: np.ndarray, links: int, metric: str) -> np.ndarray:
    """(items, 2 * links) places of each item's neighbours, -1 where there are fewer.

    Of an item's 4 * links nearest those come first to which no neighbour taken
    before is nearer than the item itself, so that links leave a dense group;
    then the nearest of the rest.  Links run both ways, the nearest stay.
    """
    n = len(v)
    near_n = min(n - 1, 4 * links)
    if near_n < 1:
        return np.full((n, 2 * links), -1, np.int32)
    src, dst, weight = [], [], []
    for lo in range(0, n, 1024):
        s = _similar(v[lo : lo + 1024], v, metric)
        own = np.arange(len(s))
        s[own, own + lo] = -np.inf
        near = np.argpartition(-s, near_n - 1, axis=1)[:, :near_n]
        score = np.take_along_axis(s, near, 1)
        order = np.lexsort((near, -score), axis=1)
        near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
        among = np.einsum("iad,ibd->iab", v[near], v[near])
        if metric == "l2":
            square = (v[near] ** 2).sum(2)
            among = 2 * among - square[:, :, None] - square[:, None, :]
        taken = np.zeros(near.shape, bool)
        for j in range(near_n):
            covered = (taken & (among[:, j] >= score[:, j : j + 1])).any(1)
            taken[:, j] = ~covered & (taken.sum(1) < links)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :links]
        src.append(np.repeat(own + lo, rank.shape[1]))
        dst.append(np.take_along_axis(near, rank, 1).ravel())
        weight.append(np.take_along_axis(score, rank, 1).ravel())
    a, b, w = np.concatenate(src), np.concatenate(dst), np.concatenate(weight)
    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
    a, b, w = a[once], b[once], w[once]
    order = np.lexsort((b, -w, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, 2 * links), -1, np.int32)
    on = place < 2 * links
    out[a[on], place[on]] = b[on]
    return out


def entries(links: np.ndarray) -> np.ndarray:
    """One item of every part of the graph that links hold together: walks begin there, so every item can be reached."""
    n = len(links)
    label = np.arange(n)
    a, b = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    a, b = a[b >= 0], b[b >= 0]
    while True:
        low = label.copy()
        # only along directed links: what an item reaches from another has that one's label
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return np.unique(label)
        label = low


def walk(v: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, scores, scored): the `beam` best items that each query of q meets, unsorted, and how many it scored.

    All queries take a step at once: each goes on from its best item that it has
    not left yet, until the beam holds none.
    """
    n, m = len(v), len(q)
    rows = np.arange(m)
    seen = np.zeros((m, n), bool)
    seen[:, starts] = True
    place = np.tile(starts.astype(np.int64), (m, 1))
    score = _similar(q, v[starts], metric)
    left = np.zeros(place.shape, bool)

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if place.shape[1] <= beam:
            return place, score, left
        at = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        return (np.take_along_axis(x, at, 1) for x in (place, score, left))

    place, score, left = best()
    while len(rows):
        open_ = np.where(left[rows] | np.isneginf(score[rows]), -np.inf, score[rows])
        at = open_.argmax(1)
        on = ~np.isneginf(open_[np.arange(len(rows)), at])
        rows, at = rows[on], at[on]
        if not len(rows):
            break
        left[rows, at] = True
        near = links[place[rows, at]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        new = np.full((m, near.shape[1]), -np.inf)
        to = near[r, c]
        s = np.einsum("id,id->i", v[to], q[rows[r]])
        new[rows[r], c] = s if metric == "ip" else 2 * s - (v[to] ** 2).sum(1) - (q[rows[r]] ** 2).sum(1)
        held = np.zeros((m, near.shape[1]), np.int64)
        held[rows] = near
        place, score, left = np.hstack([place, held]), np.hstack([score, new]), np.hstack([left, np.zeros(new.shape, bool)])
        place, score, left = best()
    return place, score, seen.sum(1)


# --- build, save, load, search --------------------------------------------------------


@dataclass
class VectorIndex:
    """Centres, a table of blocks (cell, block, n, ids, vectors, links, starts), and the least beam of a walk."""

    centres: np.ndarray
    blocks: DataFrame
    metric: str
    beam: int = 0

    def save(self, path: str, generation: str) -> None:
        """Store centres, blocks sorted by cell, and the map of ids to their places; a manifest comes last."""
        spark = self.blocks.sparkSession
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>")
        by_cell = self.blocks.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
        ids = self.blocks.select("cell", "block", F.posexplode("ids").alias("place", "item_id"))
        io.write_bundle(spark, {"centres": centres, "blocks": by_cell, "ids": ids}, path, generation, {"metric": self.metric, "beam": self.beam, "width": int(self.centres.shape[1])})

    @staticmethod
    def load(spark: SparkSession, path: str, generation: str) -> VectorIndex:
        tables, info = io.read_bundle(spark, path, generation)
        centres = tables["centres"].orderBy("cell").toPandas()
        return VectorIndex(np.stack(centres["centre"].to_numpy()), tables["blocks"], info["metric"], info.get("beam", 0))

    def size(self) -> int:
        return self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def build_index(items: DataFrame, centres: np.ndarray, metric: str = "ip", item_id: str = "item_id", vector: str = "embedding", links: int = LINKS, block: int = BLOCK) -> VectorIndex:
    """Every item in the blocks of its nearest centre; items without an id or a vector are left out, ids may repeat.

    Without `links` there is no graph, and searches score the blocks of their
    cells whole.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    rows = _clean(items, item_id, vector)
    kind = rows.schema["id"].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix_of(batch.column(1))
            cell = _nearest(v, centres)[:, 0] if len(v) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["id", "v", "cell"])

    placed = stored(rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # one row per cell, at most MAX_CELLS
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    fields = [("cell", T.IntegerType()), ("block", T.IntegerType()), ("n", T.LongType()), ("ids", T.ArrayType(kind)), ("vectors", T.BinaryType()), ("links", T.BinaryType()), ("starts", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").combine_chunks()
        v = matrix_of(table.column("v")).astype(np.float32)
        net = linked(v.astype(float), links, metric) if links else np.zeros((len(v), 0), np.int32)
        starts = entries(net).astype(np.int32) if links else np.zeros(0, np.int32)
        one = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("cell", "block")]
        whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.Table.from_arrays([*one, pa.array([len(v)]), whole, *[pa.array([x.tobytes()], pa.binary()) for x in (v, net, starts)]], names=schema.names)

    index = VectorIndex(centres, stored(dealt.groupBy("cell", "block").applyInArrow(graph, schema)), metric)
    if links:
        index.beam = _fitted_beam(index, placed.select("id", "v"))
    return index


def _fitted_beam(index: VectorIndex, items: DataFrame) -> int:
    """The least of FIT_BEAMS that reaches FIT_RECALL over all cells, else the widest; asked are the items whose ids have the least hashes."""
    asked = items.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(FIT_ITEMS)
    # one pass for all beams; 0 scores blocks whole
    found = _found(index, asked.select(F.monotonically_increasing_id().alias("id"), "v"), FIT_K, len(index.centres), [0, *FIT_BEAMS])
    far = found.select("beam", "id", F.transform("hits", lambda h: h["far"]).alias("far")).toPandas()  # FIT_ITEMS rows for each beam
    edge = {i: max(f) for b, i, f in far.itertuples(index=False) if b == 0}
    total = sum(len(f) for b, _, f in far.itertuples(index=False) if b == 0)
    for beam in FIT_BEAMS:
        hits = sum(sum(x <= edge[i] + 1e-9 * (1 + abs(edge[i])) for x in f) for b, i, f in far.itertuples(index=False) if b == beam)
        if hits >= FIT_RECALL * total:
            return beam
    return FIT_BEAMS[-1]


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, beam: int | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, item_id, score, rank, scored): the k best items of each query in its `probes` nearest cells.

    With a `beam` the graphs are walked, at least as widely as the index was
    fitted to, else blocks are scored whole; `scored` is the number of items that
    a query was compared with.  Scores are inner products or squared distances,
    equal ones ordered by id.  Queries without an id or a vector are left out.
    """
    best = _found(index, _clean(queries, query_id, vector), k, probes, [0 if beam is None else max(beam, index.beam, k)])
    out = best.select(F.col("id").alias(query_id), "scored", F.posexplode("hits").alias("place", "hit"))
    score = F.col("hit.far") if index.metric == "l2" else -F.col("hit.far")
    return out.select(query_id, F.col("hit.item_id").alias("item_id"), score.alias("score"), (F.col("place") + 1).alias("rank"), "scored")


def _found(index: VectorIndex, rows: DataFrame, k: int, probes: int, beams: list[int]) -> DataFrame:
    """(beam, id, scored, hits) of queries (id, v) with each of the beams, of which 0 scores blocks whole; hits are (far, item_id), nearest first."""
    centres, metric, probes = index.centres, index.metric, min(probes, len(index.centres))
    q_kind, i_kind = rows.schema["id"].dataType, index.blocks.schema["ids"].dataType.elementType

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(matrix_of(batch.column(1)), centres, probes)
                at = pa.array(np.repeat(np.arange(len(near)), probes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel())], names=["id", "v", "cell"])

    aimed = rows.mapInArrow(aim, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    sizes = stored(aimed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_PACKAGE).cast("int").alias("parts")))
    dealt = aimed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a package is a bounded number of queries, so a cell that very many ask is many rows
    packed = stored(dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("asked")))
    pairs = index.blocks.join(packed, "cell").select("ids", "vectors", "links", "starts", "asked")
    names = ["beam", "id", "ids", "scores", "scored"]
    schema = T.StructType([T.StructField("beam", T.IntegerType()), T.StructField("id", q_kind), T.StructField("ids", T.ArrayType(i_kind)), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("scored", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                v = np.frombuffer(batch.column("vectors")[i].as_py(), np.float32).reshape(len(ids), -1).astype(float)
                asked = batch.column("asked")[i].values
                q_ids, q = asked.field("id"), matrix_of(asked.field("v"))
                net = np.frombuffer(batch.column("links")[i].as_py(), np.int32).reshape(len(ids), -1)
                starts = np.frombuffer(batch.column("starts")[i].as_py(), np.int32)
                for lo, beam in itertools.product(range(0, len(q), 256), beams):
                    part = q[lo : lo + 256]
                    if not beam or not net.shape[1]:
                        score = _similar(part, v, metric)
                        place, scored = np.tile(np.arange(len(v)), (len(part), 1)), np.full(len(part), len(v))
                    else:
                        place, score, scored = walk(v, net, starts, part, beam, metric)
                    # items of a block are sorted by id
                    order = np.lexsort((place, -score), axis=1)[:, :k]
                    place, score = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
                    held = ~np.isneginf(score)
                    at = np.r_[0, np.cumsum(held.sum(1))].astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (ids.take(pa.array(place[held])), pa.array(score[held]))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), beam, np.int32)), q_ids.slice(lo, len(part)), *lists, pa.array(scored.astype(np.int64))], names=names)

    found = pairs.mapInArrow(find, schema)
    hit = F.transform(F.arrays_zip("ids", "scores"), lambda s: F.struct((-s["scores"]).alias("far"), s["ids"].alias("item_id")))
    best = found.select("beam", "id", "scored", hit.alias("hits")).groupBy("beam", "id")
    return best.agg(F.sum("scored").alias("scored"), F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
