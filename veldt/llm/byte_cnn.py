"""Language identification by a byte convolutional network.

Each byte has an embedding; filters of several widths slide over a fixed-length
window of bytes, the largest response of each filter is kept, and a softmax
layer turns these into language probabilities.  The network is trained here, in
numpy, by Adam on windows of a bounded sample of labelled texts.  A text's
prediction is the mean of its windows' log probabilities, over all its windows.

For prediction the embedding is folded into the filters: a filter of width w is
the sum of w table look-ups by byte, so no text is decoded and no matrix of
windows is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import free_name, prepare, read_table
from .textops import chunks

#: About so many labelled texts of each language are fetched to train, by a hash of the text's id; a fixed bound of the model.
TRAIN_TEXTS = 300
#: The sample takes so many windows of each of these texts, spread over its whole length; predictions read every window.
TRAIN_WINDOWS = 6
#: The network holds a column per language on the driver; a column of more values than this is no language column and an error.
MAX_LANGUAGES = 20_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
EPOCHS = 6
UNKNOWN = "und"


@dataclass(frozen=True)
class ByteNet:
    """Tables (width, 256, FILTERS) of each width, biases, and the softmax layer (features, languages)."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(raw: bytes, limit: int | None = None) -> np.ndarray:
    """A text's bytes as rows of WINDOW bytes, the last padded with spaces; with `limit`, so many spread evenly."""
    n = max(1, -(-len(raw) // WINDOW))
    grid = np.full(n * WINDOW, 0x20, np.uint8)
    grid[: len(raw)] = np.frombuffer(raw, np.uint8)
    grid = grid.reshape(n, WINDOW)
    return grid if limit is None or n <= limit else grid[np.linspace(0, n - 1, limit).astype(int)]


def train_net(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 3) -> ByteNet:
    """Adam on the cross entropy of single windows; labels are indices into `languages`."""
    rng = np.random.default_rng(seed)
    k, dims = len(languages), len(WIDTHS) * FILTERS
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "o": rng.normal(0, 0.1, (dims, k)), "ob": np.zeros(k)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {name: v.astype(np.float32) for name, v in p.items()}
    m = {name: np.zeros_like(v) for name, v in p.items()}
    v2 = {name: np.zeros_like(v) for name, v in p.items()}
    share = np.bincount(labels, minlength=k)
    weight = (len(labels) / np.maximum(1, share) / k).astype(np.float32)
    t, size = 0, 64
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), size):
            x, y = windows[order[lo : lo + size]], labels[order[lo : lo + size]]
            n = len(x)
            e = p["e"][x]
            pooled, where = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                h = sum(e[:, j : j + span] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"]
                where.append(h.argmax(1))
                pooled.append(h.max(1))
            f = np.maximum(np.concatenate(pooled, 1), 0)
            z = f @ p["o"] + p["ob"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(n), y] -= 1
            z *= weight[y][:, None] / n
            g = {"o": f.T @ z, "ob": z.sum(0), "e": np.zeros_like(p["e"])}
            df = (z @ p["o"].T) * (f > 0)
            for i, w in enumerate(WIDTHS):
                d = df[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = d.sum(0)
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    at = x[np.arange(n)[:, None], where[i] + j]
                    g[f"w{w}"][j] = np.einsum("nfe,nf->ef", p["e"][at], d)
                    np.add.at(g["e"], at, d[:, :, None] * p[f"w{w}"][j].T[None])
            t += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v2[name] = 0.99 * v2[name] + 0.01 * g[name] ** 2
                p[name] = p[name] - 0.01 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v2[name] / (1 - 0.99**t)) + 1e-8)
    tables = [np.stack([p["e"] @ p[f"w{w}"][j] for j in range(w)]).astype(np.float32) for w in WIDTHS]
    return ByteNet(languages, tables, [p[f"b{w}"] for w in WIDTHS], p["o"], p["ob"])


def log_probabilities(net: ByteNet, grid: np.ndarray) -> np.ndarray:
    """Log probabilities (windows, languages) of rows of WINDOW bytes."""
    pooled = []
    for table, bias in zip(net.tables, net.biases):
        w = len(table)
        span = WINDOW - w + 1
        best = np.empty((len(grid), FILTERS), np.float32)
        for lo in range(0, len(grid), 64):  # stays within the processor's cache
            x = grid[lo : lo + 64]
            h = table[0][x[:, :span]]
            for j in range(1, w):
                h += table[j][x[:, j : j + span]]
            best[lo : lo + 64] = h.max(1)
        pooled.append(best + bias)
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def predict(net: ByteNet, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language's index and its score for each text of a chunk; windows of all texts go through together."""
    size = np.diff(at)
    n = np.maximum(1, -(-size // WINDOW))
    first = np.r_[0, np.cumsum(n)]
    grid = np.full(first[-1] * WINDOW, 0x20, np.uint8)
    text = np.repeat(np.arange(len(size)), size)
    grid[np.arange(len(data)) - at[:-1][text] + first[:-1][text] * WINDOW] = data
    # the last window of a text counts by how much of it is text
    weight = np.ones(first[-1], np.float32)
    weight[first[1:] - 1] = np.maximum(1, size - (n - 1) * WINDOW) / WINDOW
    logs = np.add.reduceat(log_probabilities(net, grid.reshape(-1, WINDOW)) * weight[:, None], first[:-1], axis=0)
    logs /= np.add.reduceat(weight, first[:-1])[:, None]
    logs -= logs.max(1, keepdims=True)
    probs = np.exp(logs)
    probs /= probs.sum(1, keepdims=True)
    best = probs.argmax(1)
    return best, probs[np.arange(len(best)), best].astype(float)


def train_on(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Train on rows where `usable` holds and neither text nor language is null; None where there are none.

    Language counts cover all such rows, and every language is learned.  Of the
    texts whose id hashes lowest, about TRAIN_TEXTS of each language and never
    more than twice that in all, executors cut TRAIN_WINDOWS windows, so the
    driver gets windows and no text.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    found = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return None
    languages = sorted(counts)
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, TRAIN_TEXTS / counts[name])) for name in languages], "lang string, share double")
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select(F.col(lang_col).alias("lang"), place.alias("place"), F.col(text_col).alias("text")).join(F.broadcast(shares), "lang").where("place < share")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [windows_of(t.as_py().encode(), TRAIN_WINDOWS).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(grids, pa.binary())], names=["lang", "place", "windows"])

    windows = drawn.select("lang", "place", "text").mapInArrow(cut, "lang string, place double, windows binary")
    chosen = windows.orderBy("place", "lang", "windows").limit(2 * TRAIN_TEXTS * len(languages)).collect()
    parts = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in chosen]
    if not parts:
        return None
    index = {name: i for i, name in enumerate(languages)}
    labels = np.repeat([index[r["lang"]] for r in chosen], [len(x) for x in parts])
    return train_net(np.concatenate(parts), labels, languages)


def identify(docs: DataFrame, net: ByteNet | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score.

    A text that is null, empty or without a letter is `und` with score 0, and so
    is every text where nothing could be learned.  Very long texts are read to
    their end, window by window.  Of languages that tie the first by code point
    wins.  Rows repeated in full get equal predictions; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep))
            for first, last, data, at in chunks(text):
                part = batch.slice(first, last - first)
                lettered = pc.fill_null(pc.match_substring_regex(part.column(len(keep)), r"\pL"), False).to_numpy(zero_copy_only=False)
                names, scores = np.full(last - first, UNKNOWN, object), np.zeros(last - first)
                if net is not None and lettered.any():
                    best, score = predict(net, data, at)
                    names[lettered] = np.array(net.languages, object)[best[lettered]]
                    scores[lettered] = score[lettered]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names.tolist(), pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).alias(free_name(docs, "__text"))).mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a third of them, by crc32 of the id, is never learned from."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = train_on(docs, F.coalesce(fold != 1, F.lit(False)))
    out = identify(docs, net, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
