"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become token sequences; those longer than a sequence are cut.  Pieces
are dealt evenly to shards of bounded size by a hash, and each shard is one
packing problem, solved by several islands.  An island's individuals are
groupings of the shard's pieces into bins.  Crossover injects whole well-filled
bins of one parent into the other, drops the bins that now hold a piece twice,
and best-fits the pieces displaced by that.  After each epoch every island's
elite migrates to the next island of its ring, by a join.  A shard that reaches
the lower bound, the sum of its lengths over the capacity, is done.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import prepare, read_table, saved
from .textops import mix, release_memory

CAPACITY = 1024
END_ID = 2
PIECES_PER_SHARD = 16_384
SHARDS_PER_TASK = 16
ISLANDS = 3
EPOCHS = 3
POPULATION = 4
CROSSOVERS = 6


# --- tokens --------------------------------------------------------------------------


def _byte_chars() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable bytes are themselves, others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(spec: bytes):
    """A function text -> uint32 ids equal to Tokenizer.encode(text, add_special_tokens=False).

    `spec` is a tokenizers JSON file.  A byte-level BPE whose ids follow its
    merges runs on tiktoken, which gives the same ids several times faster; any
    other file, and any text on which tiktoken fails, goes to tokenizers.
    """
    from tokenizers import Tokenizer

    plain = []

    def slow(text: str) -> np.ndarray:
        if not plain:  # seldom needed, and large
            plain.append(Tokenizer.from_str(spec.decode()))
        return np.array(plain[0].encode(text, add_special_tokens=False).ids, np.uint32)

    d = json.loads(spec)
    model, before, added = d["model"], d.get("pre_tokenizer") or {}, d.get("added_tokens") or []
    vocab = model.get("vocab")
    special = {t["content"]: t["id"] for t in added if t.get("special")}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    byte_level = (
        model.get("type") == "BPE"
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not d.get("normalizer")
        and len(special) == len(added)
        and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
    )
    if not byte_level:
        return slow
    ranks = [vocab.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(ranks, ranks[1:])) or (ranks and ranks[0] < 256):
        return slow
    import tiktoken

    chars = _byte_chars()
    table = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except BaseException as e:  # a Rust panic on an odd text isn't an Exception
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            return slow(text)

    return encode


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces; only the first may be short."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal[, ids]), one row per piece; `deal` is a uniform number for sharding."""
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode, seen = load_encoder(spec), 0
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids), capacity)):
                    part = ids[start : start + n]
                    rows.append((i, piece, start, n, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                    start += n
            if rows:
                at, piece, start, n, crc, ids = zip(*rows)
                crcs = np.array(crc, np.int64)
                deal = mix(crcs.view(np.uint64) + np.arange(seen, seen + len(rows), dtype=np.uint64) * np.uint64(1 << 32))
                seen += len(rows)
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs), pa.array((deal >> np.uint64(1)).astype(np.int64))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
                if with_ids:
                    columns.append(pa.array(list(ids), pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# --- the genetic algorithm on one shard: lengths in falling order, groupings as bin numbers ------


class Bins:
    """Open bins ordered by free space, for best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.number, self.count = capacity, [], [], 0

    def open(self, number: int, free: int) -> None:
        if free:
            at = bisect.bisect_left(self.free, free)
            self.free.insert(at, free)
            self.number.insert(at, number)
        self.count = max(self.count, number + 1)

    def put(self, length: int) -> int:
        """The fullest bin with room for `length`, or a new one."""
        at = bisect.bisect_left(self.free, length)
        if at < len(self.free):
            free, number = self.free.pop(at), self.number.pop(at)
        else:
            free, number = self.capacity, self.count
        self.open(number, free - length)
        return number


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.empty(len(lengths), np.int32)
    for i in order:
        out[i] = bins.put(int(lengths[i]))
    return out


def _loads(lengths: np.ndarray, grouping: np.ndarray) -> np.ndarray:
    return np.bincount(grouping, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, grouping: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, uneven filling, which leaves room for later pieces."""
    load = _loads(lengths, grouping)
    return -int((load > 0).sum()), float(((load / capacity) ** 2).sum())


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of `a` into `b`, drop b's bins that held their pieces, best-fit what that displaces."""
    load = _loads(lengths, a)
    full = np.flatnonzero(load >= capacity - rng.integers(0, max(2, capacity // 64)))
    full = full[rng.random(len(full)) < rng.uniform(0.3, 0.9)]
    injected = np.isin(a, full)
    hit = np.zeros(int(b.max()) + 1, bool)
    hit[b[injected]] = True
    # a few of b's emptiest bins are broken up as well, so that their pieces can move
    loads = _loads(lengths, b)
    hit[np.argsort(loads, kind="stable")[: max(1, len(loads) // 50)]] = True
    kept = ~injected & ~hit[b]
    child = np.full(len(a), -1, np.int32)
    _, child[injected] = np.unique(a[injected], return_inverse=True)
    base = int(child.max()) + 1
    if kept.any():
        _, own = np.unique(b[kept], return_inverse=True)
        child[kept] = base + own
    held = child >= 0
    bins = Bins(capacity)
    if held.any():
        for number, n in enumerate(_loads(lengths[held], child[held])):
            bins.open(number, capacity - int(n))
    for i in np.flatnonzero(~held):
        child[i] = bins.put(int(lengths[i]))
    return child


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, crossovers: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A few generations with steady replacement of the worst; the best comes first."""
    bound = -(-int(lengths.sum()) // capacity)
    scored = sorted(((fitness(lengths, g, capacity), i, g) for i, g in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for n in range(crossovers):
        if -scored[0][0][0] <= bound:
            break
        a, b = rng.choice(len(scored), 2, replace=len(scored) < 2)
        child = crossover(lengths, scored[min(a, b)][2], scored[max(a, b)][2], capacity, rng)
        scored.append((fitness(lengths, child, capacity), len(population) + n, child))
        scored = sorted(scored, key=lambda x: (x[0], -x[1]), reverse=True)[: len(population)]
    return [g for _, _, g in scored]


STATE = "shard long, island int, bins long, bound long, lengths binary, population array<binary>"


def _pack_state(shard: int, island: int, lengths: np.ndarray, population: list[np.ndarray], capacity: int) -> dict:
    best = int((_loads(lengths, population[0]) > 0).sum()) if len(lengths) else 0
    return {
        "shard": shard, "island": island, "bins": best, "bound": -(-int(lengths.sum()) // capacity),
        "lengths": lengths.astype("<i4").tobytes(), "population": [g.astype("<i4").tobytes() for g in population],
    }


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = PIECES_PER_SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of `pieces` (length, deal and any other columns) with sequence_id and offset.

    `pieces` must be stable when read twice (checkpointed or stored).
    """
    shards = max(1, -(-pieces.count() // per_shard))
    dealt = pieces.withColumn("shard", F.pmod("deal", F.lit(shards)))

    def begin(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(rows["length"].to_numpy(np.int64))[::-1].copy()
        shard, out = int(rows["shard"].iloc[0]), []
        for island in range(islands):
            rng = np.random.default_rng([shard, island])
            first = best_fit(lengths, np.arange(len(lengths)), capacity)
            population = [first]
            if int((_loads(lengths, first) > 0).sum()) > -(-int(lengths.sum()) // capacity):
                for _ in range(POPULATION - 1):  # falling order, disturbed a little
                    population.append(best_fit(lengths, np.argsort(-lengths * (1 + 0.15 * rng.random(len(lengths))), kind="stable"), capacity))
            out.append(_pack_state(shard, island, lengths, population, capacity))
            if len(population) == 1:
                break
        return pd.DataFrame(out)

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                    population = [np.frombuffer(g, "<i4") for g in r.population] + [np.frombuffer(r.elite, "<i4")]
                    grown = evolve(lengths, population, capacity, CROSSOVERS, np.random.default_rng([r.shard, r.island, number]))
                    out.append(_pack_state(r.shard, r.island, lengths, grown[:POPULATION], capacity))
                if out:
                    yield pd.DataFrame(out)

        return run

    # packing a shard costs seconds for bytes, so tasks are dealt by shards and not by the size of their rows
    tasks = max(1, min(shards, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-shards // SHARDS_PER_TASK))
    state = dealt.select("shard", "length").repartition(tasks, "shard").groupBy("shard").applyInPandas(begin, STATE)
    state = saved(state, shards, 1)
    best = lambda: state.groupBy("shard").agg(F.min_by(F.col("population")[0], F.struct("bins", "island")).alias("grouping"), F.min("bins").alias("bins"), F.min("bound").alias("bound"))
    done = []
    for number in range(epochs):
        still = best().where("bins > bound").select("shard")
        opened = state.join(still, "shard", "left_semi")
        if opened.select("shard").first() is None:
            break
        done.append(state.join(still, "shard", "left_anti"))
        elites = opened.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("population")[0].alias("elite"))
        state = saved(opened.join(elites, ["shard", "island"]).repartition(tasks, "shard", "island").mapInPandas(epoch(number), STATE), shards, 1)
    for rows in done:
        state = state.unionByName(rows)

    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: pa.Table, found: pa.Table) -> pa.Table:
        # Arrow, not pandas: a column of ids with a null in it must not become one of floats
        length, deal = (rows.column(c).to_numpy().astype(np.int64) for c in ("length", "deal"))
        order = np.lexsort((deal, -length))
        grouping = np.frombuffer(found.column("grouping")[0].as_py(), "<i4").astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)
        length = length[order]
        by = np.argsort(grouping, kind="stable")
        run = np.cumsum(length[by]) - length[by]
        first = np.r_[True, grouping[by][1:] != grouping[by][:-1]] if len(by) else np.zeros(0, bool)
        offset = np.empty(len(by), np.int64)
        offset[by] = run - run[first][np.cumsum(first) - 1]
        rows = rows.take(pa.array(order))
        shard = rows.column("shard")[0].as_py() if rows.num_rows else 0
        return rows.append_column("sequence_id", pa.array((shard << 32) + grouping)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").cogroup(best().select("shard", "grouping").groupBy("shard")).applyInArrow(place, schema).drop("shard", "deal")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    Null and empty texts are the end token alone; very long ones are cut into
    many pieces; rows that repeat an id or have none are packed as documents of
    their own; other columns, whatever their names, are ignored; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    return pack_pieces(tokenised_pieces(docs, tokenizer_path, capacity, END_ID, id_col, text_col, with_ids).checkpoint(), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), default_tokenizer())
