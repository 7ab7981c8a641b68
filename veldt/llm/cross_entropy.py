"""Language-model scoring by cross-entropy difference.

A target model (documents labelled good) and a background model (all documents)
are matched: interpolated bigram models of the same order, smoothing and
vocabulary, counted over every whole text.  The vocabulary is every word that
occurs twice, at any size of the corpus; other words are one unknown word.
Bigrams that occur twice are kept too, so both tables grow with the corpus.

They are therefore never gathered.  Documents are stored in chunks; a chunk
sends its distinct words and bigrams, packed, to hash buckets that add them up,
and each bucket answers every chunk with the counts of what that chunk sent, in
the same order.  A chunk scores its documents from its answers.

A document is scored with its own counts taken out of both models, so a good
document is not preferred for having been counted.  A bigram that occurs once in
the corpus counts 0 for the one document that asks for it, so leaving these out
changes no score: the models are those of the rest of the corpus.  The score is the mean over
its tokens of target loss minus background loss, in nats: low is target-like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bucket_count, prepare, read_table
from .textops import LOWER, chunks, mix, release_memory, span_hashes, words

#: Words and bigrams count from two occurrences on; a share of all tokens above 0 raises that.
SHARE = 0.0
BIGRAM_WEIGHT = 0.6
PSEUDO_COUNT = 0.5
#: Target ids are broadcast up to this many (8 bytes each, 16 MB); beyond, documents are shuffled by id.
BROADCAST_IDS = 2_000_000
#: Text of one chunk: larger ones repeat fewer keys, smaller ones need less memory.
STORED_BYTES = 8 << 20
UNKNOWN = np.uint64(1)

CHUNKS = "chunk long, docs binary, tokens long, target_tokens long"
CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("tokens", pa.int64()), ("target_tokens", pa.int64())])
COUNTS = "bucket int, chunk long, keys binary, background binary, target binary"
COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())])
ANSWERS = "bucket int, chunk long, background binary, target binary, held long, background_sum long, target_sum long"
ANSWERS_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("background", pa.binary()), ("target", pa.binary()), ("held", pa.int64()), ("background_sum", pa.int64()), ("target_sum", pa.int64())])


@dataclass(frozen=True)
class Table:
    """Sorted keys with their counts in the background and in the target."""

    keys: np.ndarray
    background: np.ndarray
    target: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def sum_by_key(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *[np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them, compressed; the first byte is the width."""
    kind = np.min_scalar_type(int(counts.max()))
    raw = counts.astype(kind).tobytes()
    return bytes([kind.itemsize]) + pa.compress(raw, "zstd", asbytes=True)


def _wide(packed: bytes, n: int) -> np.ndarray:
    """The n counts of `_narrow`."""
    raw = pa.decompress(packed[1:], n * packed[0], "zstd", asbytes=True)
    return np.frombuffer(raw, f"u{packed[0]}").astype(np.int64)


def _near(keys: np.ndarray) -> bytes:
    """Keys in order by their differences: number, width, the lower bytes plane by plane, and the highest bytes compressed."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(step.max()).bit_length() // 8))
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + bytes([width]) + planes[: width - 1].tobytes() + pa.compress(planes[width - 1].tobytes(), "zstd", asbytes=True)


def _far(packed: bytes) -> np.ndarray:
    """The keys of `_near`."""
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    edge = 5 + n * (width - 1)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : width - 1] = np.frombuffer(packed[5:edge], np.uint8).reshape(width - 1, n).T
    planes[:, width - 1] = np.frombuffer(pa.decompress(packed[edge:], n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(planes.view("<u8")[:, 0], dtype=np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the n + 1 offsets of each text's words."""
    data = LOWER[data]
    start, end, word_at = words(data, at)
    return np.maximum(span_hashes(data, start, end), UNKNOWN + np.uint64(1)), word_at


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(3) + second)


def _pairs(ids: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Positions whose word has a predecessor in the same text."""
    inner = np.ones(len(ids), bool)
    starts = word_at[:-1]
    inner[starts[starts < len(ids)]] = False
    return np.flatnonzero(inner)


def _stored(docs: DataFrame) -> DataFrame:
    """Rows (id, text, is_target) in chunks of whole documents, compressed, with their numbers of tokens; a checkpoint, so that chunks keep their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = (task.partitionId() if task else 0) << 33
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                for part in held:
                    writer.write_batch(part)
            n = np.zeros(2, np.int64)
            for part in held:
                flags = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for first, last, data, at in chunks(part.column(1)):
                    own = np.diff(words(data, at)[2])
                    n += own.sum(), own[flags[first:last]].sum()
            return pa.RecordBatch.from_pylist([{"chunk": name, "docs": sink.getvalue().to_pybytes(), "tokens": int(n[0]), "target_tokens": int(n[1])}], CHUNKS_ARROW)

        for batch in batches:
            for first, last, data, _ in chunks(batch.column(1), STORED_BYTES):
                if held and size + len(data) > STORED_BYTES:
                    yield chunk()
                    name, held, size = name + 1, [], 0
                held.append(pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns], names=["id", "text", "is_target"]))
                size += len(data)
        if held:
            yield chunk()
        release_memory()

    return docs.mapInArrow(run, CHUNKS).checkpoint()


def _texts(docs: bytes) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, target flags, word hashes, word offsets) of runs of a chunk's documents."""
    for batch in pa.ipc.open_stream(docs):
        flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, last, data, at in chunks(batch.column(1)):
            yield batch.column(0).slice(first, last - first), flags[first:last], *word_hashes(data, at)


def _keys(docs: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, keys, background, target) of a chunk's distinct words, then of its bigrams in as many buckets after them; keys in order."""
    held = ([], [])
    for _, flags, hashes, word_at in _texts(docs):
        marked = np.repeat(flags, np.diff(word_at)).astype(np.int64)
        p = _pairs(hashes, word_at)
        for own, keys, target in ((held[0], hashes, marked), (held[1], pair_keys(hashes[p - 1], hashes[p]), marked[p])):
            own.append(sum_by_key(keys, np.ones(len(keys), np.int64), target))
    for kind, own in enumerate(held):
        if not own:
            continue
        counts = sum_by_key(*[np.concatenate(x) for x in zip(*own)])
        own.clear()
        bucket = (counts[0] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edge = np.r_[np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
        for a, b in zip(edge[:-1], edge[1:]):
            yield int(bucket[order[a]]) + kind * buckets, *[c[order[a:b]] for c in counts]


def _answers(stored: DataFrame, buckets: int, least: int) -> DataFrame:
    """For each chunk and bucket the counts over all chunks, 0 for keys that occur less than `least` times.

    A bigram occurs no more often than its words, so bigrams that are kept have
    their words in the vocabulary.  Sums over a word bucket's vocabulary stand in its first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [
                    {"bucket": bucket, "chunk": name, "keys": _near(keys // np.uint64(buckets)), "background": _narrow(background), "target": _narrow(target)}
                    for bucket, keys, background, target in _keys(docs.as_py(), buckets)
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, COUNTS_ARROW)
        release_memory()

    def total(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_far(k) for k in table.column("keys").to_pylist()]  # keys of one bucket differ in their quotients
        edge = np.cumsum([0, *map(len, parts)])
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        sums = []
        for name in ("background", "target"):
            sent = np.concatenate([_wide(c, len(k)) for c, k in zip(table.column(name).to_pylist(), parts)])
            sums.append(np.add.reduceat(sent[order], first))
        on = sums[0] >= least
        totals = [int(on.sum()), int(sums[0][on].sum()), int(sums[1][on].sum())] if bucket < buckets else [0, 0, 0]
        found = []
        for s in sums:
            out = np.empty(len(keys), np.int64)
            out[order] = np.repeat(np.where(on, s, 0), size)
            found.append([_narrow(out[a:b]) for a, b in zip(edge[:-1], edge[1:])])
        more = [0] * (len(parts) - 1)
        out = pa.table([table.column("bucket"), table.column("chunk"), *found, *[[t, *more] for t in totals]], schema=ANSWERS_ARROW)
        release_memory()
        return out

    return stored.select("chunk", "docs").mapInArrow(run, COUNTS).groupBy("bucket").applyInArrow(total, ANSWERS).checkpoint()


@dataclass(frozen=True)
class Models:
    """What a chunk needs of both models: its words and bigrams that are held, and the whole corpus's sums."""

    words: Table
    pairs: Table
    tokens: int
    target_tokens: int
    held: int
    background_sum: int
    target_sum: int


def _own_models(docs: bytes, buckets: int, answers: pa.Table, sums: tuple[int, ...]) -> Models:
    """The models of a chunk's own keys, from the buckets' answers."""
    found = {b: (x, y) for b, x, y in zip(*[answers.column(c).to_pylist() for c in ("bucket", "background", "target")])}
    held = ([], [])
    for bucket, keys, _, _ in _keys(docs, buckets):
        background, target = (_wide(c, len(keys)) for c in found[bucket])
        on = background > 0
        held[bucket >= buckets].append((keys[on], background[on], target[on]))
    tables = []
    for own in held:
        keys, background, target = [np.concatenate(x) for x in zip(*own)] if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        tables.append(Table(keys[order], background[order], target[order]))
    return Models(*tables, *sums)


def _own(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs among `keys`."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(keys)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(size, size)
    return out


def losses(models: Models, hashes: np.ndarray, word_at: np.ndarray, in_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target and background loss of each token, the text's own counts left out."""
    n = np.diff(word_at)
    text = np.repeat(np.arange(len(n)), n)
    salt = mix(np.arange(len(n), dtype=np.uint64) + np.uint64(11))[text]
    at = models.words.find(hashes)
    word = np.where(at >= 0, hashes, UNKNOWN)
    own = _own(word ^ salt)
    p = _pairs(hashes, word_at)
    p = p[(at[p] >= 0) & (at[p - 1] >= 0)]
    keys = pair_keys(hashes[p - 1], hashes[p])
    pair_at = models.pairs.find(keys)
    pair_own = _own(keys ^ salt[p])
    out = []
    size = models.held + 1
    for counts, pairs, total, known, taken in (
        (models.words.target, models.pairs.target, models.target_tokens, models.target_sum, in_target[text].astype(np.int64)),
        (models.words.background, models.pairs.background, models.tokens, models.background_sum, np.ones(len(text), np.int64)),
    ):
        counts = np.append(counts, total - known)  # -1 finds the unknown word
        single = counts[at] - own * taken
        loss = (single + PSEUDO_COUNT) / (total - n[text] * taken + PSEUDO_COUNT * size)
        if len(p):
            both = np.where(pair_at >= 0, np.append(pairs, 0)[pair_at] - pair_own * taken[p], 0)
            context = single[p - 1]
            linked = np.divide(both, context, out=np.zeros(len(p)), where=context > 0)
            loss[p] = np.where(context > 0, BIGRAM_WEIGHT * linked + (1 - BIGRAM_WEIGHT) * loss[p], loss[p])
        out.append(-np.log(loss))
    return out[0], out[1]


SCORES = [("n_tokens", T.LongType()), ("ce_target", T.DoubleType()), ("ce_background", T.DoubleType()), ("ce_diff", T.DoubleType())]


def mark_target(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., text, is_target): documents whose id is in `target` (id) are marked."""
    ids = target.select(F.col("id").alias("__id")).where("__id is not null").distinct().checkpoint()
    held = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    rows = docs.select(*keep, F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    return rows.join(held, F.col("__doc") == F.col("__id"), "left").select(*keep, "text", F.col("__id").isNotNull().alias("is_target"))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(id, n_tokens, ce_target, ce_background, ce_diff), one row per document.

    Null and empty texts have no tokens and scores of 0; very long ones are
    counted and scored whole; without target documents the target model is its
    smoothing alone; rows repeated in full are counted and scored each; a row
    without an id is never in the target; other columns, whatever their names,
    are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    marked = mark_target(docs, target, id_col, text_col, (id_col,))
    buckets = bucket_count(marked)
    stored = _stored(marked.select(id_col, "text", "is_target"))
    all_ = stored.agg(F.sum("tokens").alias("n"), F.sum("target_tokens").alias("t")).first()
    tokens, target_tokens = int(all_["n"] or 0), int(all_["t"] or 0)
    answers = _answers(stored, buckets, max(2, int(np.ceil(share * tokens))))
    sums = (tokens, target_tokens, *[int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("held", "background_sum", "target_sum")]).first()])
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, t) for c, t in SCORES]])

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        text = chunk.column("docs")[0].as_py()
        models = _own_models(text, buckets, found, sums)
        parts = []
        for ids, flags, hashes, word_at in _texts(text):
            means = []
            n = np.diff(word_at)
            for loss in losses(models, hashes, word_at, flags):
                total = np.r_[0.0, np.cumsum(loss)]
                means.append((total[word_at[1:]] - total[word_at[:-1]]) / np.maximum(1, n))
            columns = [ids, pa.array(n), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])]
            parts.append(pa.RecordBatch.from_arrays(columns, names=schema.names))
        out = pa.Table.from_batches(parts)
        release_memory()
        return out

    asked = stored.select("chunk", "docs").groupBy("chunk")
    return asked.cogroup(answers.select("chunk", "bucket", "background", "target").groupBy("chunk")).applyInArrow(run, schema)


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; documents labelled good and not toxic are the target."""
    labels = read_table(spark, sf_dir, "labels")
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id"))
    return score(read_table(spark, sf_dir, "documents"), good)
