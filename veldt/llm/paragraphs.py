"""Repeated passages: MinHash banding over paragraphs, exact verification, components.

A paragraph is a line of a text with at least `min_words` words; blank lines part
paragraphs like others, and a line is never cut.  Its content is the sequence of
its words, A-Z lower-cased, and it is compared by the set of its 5-word shingles.

The number of bands is tuned so that contents at the threshold collide in one
with a probability of at least RECALL.  Contents are sent once for each band to
the bucket of that band's key, and those that share a key are a block; blocks with
the same least content are one.  A block's pairs are verified by exact Jaccard
similarity in a trie, and the components of all links are the classes.

Passages are also copied into the middle of lines, where no paragraph of another
text is like the line they stand in.  So windows of WINDOW_WORDS words are
compared too, by equality: they begin at anchors, which depend on the words
around them alone.  Of every STARTS places where a window could begin the one
whose three words have the least hash is an anchor, so a passage of PASSAGE_WORDS
words holds at least one whole window, the same one in every copy.

A class has paragraphs, or windows, of two documents or more.  Its first stays
and the others are removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .exchange import FLUSH_KEYS, received
from .ngram_join import PERCENT, SHINGLE, solve_blocks
from .session import bucket_count, prepare, read_table, saved, small_side, written
from .textops import LOWER, chunks, distinct_sorted, mix, powers, release_memory, span_hashes, words

#: Lines of fewer words, as headings and one-line notices, are no passages.
MIN_WORDS = 20
#: A repeated passage of so many words is found, wherever it stands.
PASSAGE_WORDS = 51
WINDOW_WORDS = 40
STARTS = PASSAGE_WORDS - WINDOW_WORDS + 1
ANCHOR_WORDS = 3
RECALL = 0.995
#: Names of repeated or colliding contents are broadcast up to this many (8 bytes each, 32 MB); beyond, units are shuffled by name.
BROADCAST_NAMES = 4_000_000
#: A task remembers so many names at most; when it forgets, it sends some contents again, which then count as repeating.
REMEMBERED = 500_000
#: Two kinds of units.
PARAGRAPH, WINDOW = 0, 1


def tune_bands(threshold: float, recall: float = RECALL, max_rows: int = 8, noise: float = 15.0) -> tuple[int, int]:
    """(bands, rows): the recall is met at the threshold; cost counts bands and the area of false candidates below half of it."""
    best = None
    for rows in range(1, max_rows + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        grid = [(i + 0.5) / 200 * threshold for i in range(100)]
        false = sum(1 - (1 - s**rows) ** bands for s in grid) / 100
        if best is None or bands + noise * false < best[0]:
            best = (bands + noise * false, bands, rows)
    return best[1], best[2]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on; the last k - 1 places have none."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(31) + hashes[j : j + n])
    return mix(out + np.uint64(k))


def anchors(hashes: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Word places of the anchors of all texts of a chunk, in order.

    Of equal hashes the first counts; a place whose words are those of the place
    before, as in a run of one word, is none.
    """
    key = rolling(hashes, ANCHOR_WORDS)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    ranked = key.copy()
    ranked[1:][key[1:] == key[:-1]] = most
    room = np.diff(word_at) - WINDOW_WORDS + 1  # places of each text
    own = word_at[:-1][room > 0]
    ranked[own] = key[own]
    windows = np.maximum(0, room - STARTS + 1)
    before = np.cumsum(windows) - windows
    begin = np.repeat(word_at[:-1] - before, windows) + np.arange(windows.sum())
    found = begin + np.lib.stride_tricks.sliding_window_view(ranked, STARTS)[begin].argmin(1) if len(begin) else begin
    short = [word_at[i] + int(ranked[word_at[i] : word_at[i] + room[i]].argmin()) for i in np.flatnonzero((room > 0) & (room < STARTS))]
    found = np.unique(np.concatenate([found, np.array(short, np.int64)]).astype(np.int64))
    return found[ranked[found] != most]


class Units:
    """The units of a chunk, by text, start and kind: number within the text, place in code points, kind and name."""

    def __init__(self, data: np.ndarray, at: np.ndarray, min_words: int):
        data = LOWER[data]
        start, end, word_at = words(data, at)
        hashes = span_hashes(data, start, end)
        # a word begins a line where a text begins or a line end stands before it
        line_ends = np.r_[0, np.cumsum(data == 10)]
        line = line_ends[start]
        fresh = np.r_[True, line[1:] != line[:-1]] if len(start) else np.zeros(0, bool)
        fresh[word_at[:-1][word_at[:-1] < len(start)]] = True
        first = np.flatnonzero(fresh)
        last = np.r_[first[1:], len(start)] - 1 if len(first) else first
        long = last - first + 1 >= min_words
        first, last = first[long], last[long]
        window = anchors(hashes, word_at)
        kind = np.r_[np.full(len(first), PARAGRAPH), np.full(len(window), WINDOW)].astype(np.int32)
        first, last = np.r_[first, window], np.r_[last, window + WINDOW_WORDS - 1]
        order = np.lexsort((kind, first))
        self.first, self.last, self.kind = first[order], last[order], kind[order]
        self.text = np.searchsorted(word_at, self.first, "right") - 1
        self.number = np.arange(len(self.first)) - np.searchsorted(self.text, self.text)
        chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        self.start = chars[start[self.first]] - chars[at[self.text]]
        self.length = chars[end[self.last]] - chars[start[self.first]]
        up, down = powers(len(hashes))
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)]
        size = (self.last - self.first + 1).astype(np.uint64)
        self.names = mix((total[self.last + 1] - total[self.first]) * down[self.first] + size * np.uint64(2) + self.kind.astype(np.uint64))
        self.shingles = rolling(hashes, SHINGLE)

    def shingle_set(self, i: int) -> np.ndarray:
        return distinct_sorted(self.shingles[self.first[i] : max(self.first[i] + 1, self.last[i] - SHINGLE + 2)])

    def band_keys(self, on: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """Band keys (paragraphs of `on`, bands), 64 bits each."""
        out = np.zeros((len(on), bands), np.uint64)
        if not len(on):
            return out
        # all paragraphs' shingles side by side: each has one at least
        count = np.maximum(1, self.last[on] - self.first[on] - SHINGLE + 2)
        begin = np.cumsum(count) - count
        held = self.shingles[np.repeat(self.first[on] - begin, count) + np.arange(count.sum())]
        for band in range(bands):
            key = np.full(len(on), band + 1, np.uint64)
            for row in range(rows):
                salt = mix(np.array([band * rows + row + 1], np.uint64))
                key = mix(key * np.uint64(31) + np.minimum.reduceat(mix(held ^ salt), begin))
            out[:, band] = key
        return out


SENT = "bucket int, keys binary, names binary, windows binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("names", pa.binary()), ("windows", pa.binary())])


def _packed(keys: np.ndarray, names: np.ndarray, windows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: paragraphs by the bucket of their key, windows by that of their name."""
    parts = []
    for by, columns in ((keys, (keys, names)), (windows, (windows,))):
        bucket = (by % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        parts.append((edge, [c[order] for c in columns]))
    (pe, (k, n)), (we, (w,)) = parts
    full = np.flatnonzero((np.diff(pe) > 0) | (np.diff(we) > 0)).tolist()
    cut = lambda x, e: pa.array([x[e[b] : e[b + 1]].tobytes() for b in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(k, pe), cut(n, pe), cut(w, we)], schema=SENT_ARROW)


def _sent(docs: DataFrame, text_col: str, bands: int, rows: int, buckets: int, min_words: int) -> DataFrame:
    """Packed units; a task sends a content twice at most, which tells that it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, held, n = set(), set(), [], 0
        flush = lambda: _packed(*(np.concatenate(x) for x in zip(*held)), buckets)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                found = Units(data, at, min_words)
                if not len(found.names):
                    continue
                names, place, count = np.unique(found.names, return_index=True, return_counts=True)
                times = np.zeros(len(names), np.int64)
                for i, (name, c) in enumerate(zip(names.tolist(), count.tolist())):
                    if name in twice:
                        continue
                    known = name in once
                    times[i] = 1 if known or c == 1 else 2
                    if known or c > 1:
                        twice.add(name)
                    once.add(name)
                if len(once) > REMEMBERED:
                    once, twice = set(), set()
                send = np.repeat(place, times)
                own = send[found.kind[send] == PARAGRAPH]
                held.append((found.band_keys(own, bands, rows).ravel(), np.repeat(found.names[own], bands), found.names[send[found.kind[send] == WINDOW]]))
                n += len(held[-1][0]) + len(held[-1][2])
                if n >= FLUSH_KEYS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        release_memory()

    return docs.select(text_col).mapInArrow(run, SENT)


def _collide(table: pa.Table) -> pa.Table:
    """(sid, block) of a bucket: contents that share a band's key with others, and with block null those that repeat."""
    keys, names, windows = received(table, {"keys": np.uint64, "names": np.uint64, "windows": np.uint64})
    again = lambda x: x[1:][x[1:] == x[:-1]]
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    same, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (names[1:] == names[:-1])
    repeated = np.unique(np.r_[names[same], again(np.sort(windows))])
    keys, names, shared = keys[~same], names[~same], shared[~same]
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:].copy()
    sid = np.r_[names[shared], repeated].view(np.int64)
    block = np.r_[keys[shared], np.zeros(len(repeated), np.uint64)].view(np.int64)
    return pa.table({"sid": pa.array(sid), "block": pa.array(block, mask=np.arange(len(sid)) >= int(shared.sum()))})


def _members(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n: int, min_words: int) -> DataFrame:
    """(id, h, unit, kind, start, length, name, n, tokens) of the units whose content is in `wanted` (sid, near).

    A task gives the shingles of each content with `near` set where it meets it
    first; h is a hash of the text.
    """
    small = n <= BROADCAST_NAMES
    held = wanted.toArrow().sort_by("sid") if small else None
    names = docs.sparkSession.sparkContext.broadcast((held["sid"].to_numpy(), held["near"].to_numpy()) if small else None)
    kinds = {"unit": T.IntegerType(), "kind": T.IntegerType(), "start": T.IntegerType(), "length": T.IntegerType(), "name": T.LongType(), "n": T.LongType(), "tokens": T.BinaryType()}
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), *[T.StructField(c, k) for c, k in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, given = names.value, set()
        for batch in batches:
            if len(given) > REMEMBERED:
                given = set()
            for first, last, data, at in chunks(batch.column(2)):
                found = Units(data, at, min_words)
                own = found.names.view(np.int64)
                near = found.kind == PARAGRAPH
                on = np.arange(len(own))
                if known is not None:
                    place = np.minimum(np.searchsorted(known[0], own), max(0, len(known[0]) - 1))
                    on = np.flatnonzero(known[0][place] == own) if len(known[0]) else on[:0]
                    near = known[1][place] if len(known[0]) else near
                if not len(on):
                    continue
                sets = []
                for i in on.tolist():
                    name = int(own[i])
                    sets.append(found.shingle_set(i) if near[i] and name not in given else None)
                    if near[i]:
                        given.add(name)
                text = pa.array(found.text[on])
                columns = [batch.column(i).slice(first, last - first).take(text) for i in (0, 1)]
                columns += [pa.array(x[on].astype(np.int32)) for x in (found.number, found.kind, found.start, found.length)]
                columns += [pa.array(own[on]), pa.array([None if x is None else len(x) for x in sets], pa.int64()), pa.array([None if x is None else x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        release_memory()

    out = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"), text_col).mapInArrow(run, schema)
    if not small:
        out = out.join(wanted.select(F.col("sid").alias("name"), "near").hint("merge"), "name").withColumn("tokens", F.when(F.col("near"), F.col("tokens"))).select(*schema.names)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Units of repeated passages: (id, h, unit, kind, start, length, class_id, class_unit, class_size, removed).

    kind is `paragraph` or `window`; `unit` numbers all of a text's units by
    place, places are code points, and h is a hash of the text.  A document is
    an id with a text: rows repeated in full are one document, rows of one id,
    or of none, with other texts are others.  Classes have units of two
    documents or more; the one with the smallest (id, h, unit) stays, null ids
    last, also among those that tie.  Null, empty and short texts have no unit;
    very long ones are read whole; other columns, whatever their names, are
    ignored; an empty table gives an empty result.
    """
    if min_words < SHINGLE:
        raise ValueError(f"paragraphs of {SHINGLE} words at least")
    prepare(docs.sparkSession)
    bands, rows = tune_bands(percent / 100)
    buckets = bucket_count(docs)
    hits = saved(_sent(docs, text_col, bands, rows, buckets, min_words).groupBy("bucket").applyInArrow(_collide, "sid long, block long"))
    wanted = saved(hits.groupBy("sid").agg(F.max(F.col("block").isNotNull()).alias("near")))
    n = wanted.count()
    members = written(_members(docs, id_col, text_col, wanted, n, min_words))
    # several tasks may give the same content
    contents = saved(members.where("tokens is not null").select(F.col("name").alias("sid"), "n", "tokens").dropDuplicates(["sid"]), n, 20_000)
    # blocks of one least content are one block: contents that share keys of several bands are sent once, mostly
    near = hits.where("block is not null")
    least = saved(near.groupBy("block").agg(F.min("sid").alias("least")), n)
    blocks = saved(near.join(least, "block").select("sid", F.col("least").alias("block")).distinct(), n)
    links = solve_blocks(blocks, contents, buckets, percent, rows=n)
    roots = saved(connected_components(links, "sid", "root", n).select(F.col("node").alias("name"), F.col("component").alias("root")), n)
    units = members.select(F.struct(F.col("id").isNull().alias("none"), "id", "h").alias("doc"), "unit", "kind", "start", "length", "name")
    # stored already, so that a content that repeats very often can be split
    placed = units.join(small_side(roots, roots.count(), 16), "name", "left").withColumn("root", F.coalesce("root", "name")).drop("name")
    classes = placed.groupBy("root").agg(F.min(F.struct("doc", "unit")).alias("first"), F.count("*").alias("class_size"), F.max("doc").alias("last")).where("first.doc < last").drop("last")
    # there are about as many classes as contents that repeat: a join that would soon shuffle always does
    found = placed.join(saved(classes, n).hint("merge"), "root")
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("unit") == F.col("first.unit"))
    kind = F.when(F.col("kind") == PARAGRAPH, "paragraph").otherwise("window")
    return found.select("doc.id", "doc.h", "unit", kind.alias("kind"), "start", "length", F.col("first.doc.id").alias("class_id"), F.col("first.unit").alias("class_unit"), "class_size", (~stays).alias("removed"))


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and window of a passage that repeats, its class and whether it goes; documents without one have no row."""
    out = repeated_passages(read_table(spark, sf_dir, "documents"))
    return out.drop("h").withColumnsRenamed({"id": "doc_id", "unit": "paragraph", "class_id": "class_doc_id", "class_unit": "class_paragraph"})
