"""Quality rules: a linear-chain conditional random field labels the lines of a text.

Each line that has a word is CONTENT or BOILERPLATE.  Emissions are linear in
cheap line features, transitions favour staying in a state, and Viterbi decoding
labels the whole text at once.  The share of words on content lines decides
whether the text is kept, after the base rules.

The field is trained here, by maximum likelihood, on a bounded sample of
labelled documents (`TRAIN_DOCS`).  Lines have no labels of their own: those of
good documents are content, those of bad documents are hidden.  Hard expectation
maximisation starts with all of these as boilerplate, fits the field, decodes
the bad documents again, and goes on until their labels stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import free_name, prepare, read_table
from .textops import chunks, mix, span_hashes, utf8, words

#: At most so many labelled documents are read to fit the field, by a hash of their id, ...
TRAIN_DOCS = 1000
#: ... of each a stretch of at most so many lines, which begins where a hash of the text says, ...
TRAIN_LINES = 256
#: ... in at most so many rounds.
EM_ROUNDS = 8
UNLINKED_ROUNDS = 2
MIN_CONTENT_SHARE = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
SHOUT = np.zeros(256, bool)
SHOUT[list(b"!?")] = True
CLOSING = np.zeros(256, bool)
CLOSING[list(b".?!:;\"')")] = True

FEATURES = ("bias", "log_words", "symbols", "upper", "digits", "shouting", "closed", "repeated", "word_length", "very_short")


@dataclass(frozen=True)
class LineField:
    """Weights (2, n_features), transitions (2, 2) and starts (2,); state 1 is content."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray


#: Used where no labelled document is at hand: symbols, capitals and repeats speak against content.
DEFAULT_FIELD = LineField(
    np.array([[-2.0, 0, 5.0, 6.0, 3.0, 2.0, 0, 1.5, 0, 0.5], [0.0] * 10]),
    np.array([[0.5, -0.5], [-0.5, 0.5]]),
    np.zeros(2),
)


@dataclass(frozen=True)
class Measured:
    """Counts of each text of a chunk, and its lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_at: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _prefix(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(keys: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys occur twice or more; the first occurrence counts only if asked for."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same
    if first_too:
        same[:-1] |= same[1:]
        out[order] = same
    return out


def measure(data: np.ndarray, at: np.ndarray) -> Measured:
    """All counts and line features of whole texts, from their bytes."""
    n_texts = len(at) - 1
    start, end, word_at = words(data, at)
    n_words = np.diff(word_at)
    char = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, start, 1)
    np.add.at(in_word, end, -1)
    chars = _prefix(char & (np.cumsum(in_word)[:-1] > 0))
    symbols = _prefix(SYMBOLS[data])

    text_of_word = np.repeat(np.arange(n_texts), n_words)
    salt = mix(np.arange(n_texts, dtype=np.uint64) + np.uint64(7))
    repeated = np.zeros(len(start), bool)
    windows = np.flatnonzero(np.arange(len(start)) + 2 < word_at[1:][text_of_word])
    if len(windows):
        h = span_hashes(data, start, end)
        key = mix(mix(h[windows] * np.uint64(3) + h[windows + 1]) * np.uint64(5) + h[windows + 2]) ^ salt[text_of_word[windows]]
        repeated[windows] = _repeated(key, first_too=True)
    covered = repeated.copy()
    covered[1:] |= repeated[:-1]
    covered[2:] |= repeated[:-2]

    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([at[:-1], breaks + 1])
    line_end = np.concatenate([at[1:], breaks])
    line_start, line_end = np.sort(line_start), np.sort(line_end)
    first = np.searchsorted(start, line_start)
    line_words = np.searchsorted(start, line_end) - first
    full = line_words > 0
    line_start, line_end, first, line_words = line_start[full], line_end[full], first[full], line_words[full]
    text_of_line = text_of_word[first]
    dup = _repeated(span_hashes(data, line_start, line_end) ^ salt[text_of_line], first_too=False) if len(first) else np.zeros(0, bool)

    size = np.maximum(1, chars[line_end] - chars[line_start]).astype(float)
    share = lambda table: (lambda p: (p[line_end] - p[line_start]) / size)(_prefix(table[data]))
    last = end[first + line_words - 1] - 1
    features = np.stack(
        [
            np.ones(len(first)),
            np.log1p(line_words) / 4,
            10 * share(SYMBOLS),
            share(UPPER),
            share(DIGIT),
            10 * share(SHOUT),
            CLOSING[data[last]] if len(first) else np.zeros(0),
            dup,
            np.minimum(size / line_words, 30) / 10,
            line_words < 4,
        ],
        axis=1,
    ).astype(float)
    total = _prefix(covered)
    dups = _prefix(dup)
    line_at = np.searchsorted(text_of_line, np.arange(n_texts + 1))
    return Measured(
        n_words, chars[at[1:]] - chars[at[:-1]], symbols[at[1:]] - symbols[at[:-1]], dups[line_at[1:]] - dups[line_at[:-1]],
        total[word_at[1:]] - total[word_at[:-1]], line_at, line_words, features,
    )


def viterbi(field: LineField, features: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """The best label sequence of every text; all texts advance one line at a time together."""
    labels = np.zeros(len(features), np.int8)
    n_lines = np.diff(line_at)
    order = np.argsort(-n_lines, kind="stable")
    ends = np.sort(n_lines)
    emit = features @ field.emit.T
    back = np.zeros((len(features), 2), np.int8)
    best = np.zeros((len(order), 2))
    for t in range(int(n_lines.max(initial=0))):
        on = len(ends) - int(np.searchsorted(ends, t, "right"))
        line = line_at[:-1][order[:on]] + t
        if t == 0:
            best[:on] = field.start + emit[line]
            continue
        paths = best[:on, :, None] + field.step[None]
        back[line] = paths.argmax(1)
        best[:on] = paths.max(1) + emit[line]
    on = len(ends) - int(np.searchsorted(ends, 0, "right"))
    state = np.zeros(len(order), np.int8)
    state[:on] = best[:on].argmax(1)
    for t in range(int(n_lines.max(initial=0)) - 1, -1, -1):
        on = len(ends) - int(np.searchsorted(ends, t, "right"))
        line = line_at[:-1][order[:on]] + t
        labels[line] = state[:on]
        state[:on] = back[line, state[:on]]
    return labels


def fit_field(texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.2, linked: bool = True) -> LineField:
    """Maximum likelihood by gradient ascent (Adam); texts are (features, labels) of one text each; lines not `linked` have no transitions."""
    texts = [t for t in texts if len(t[0])]
    if len({int(y) for _, labels in texts for y in np.unique(labels)}) < 2:
        return DEFAULT_FIELD
    texts.sort(key=lambda t: -len(t[0]))
    x = np.concatenate([f for f, _ in texts])
    y = np.concatenate([lab for _, lab in texts]).astype(int)
    n = np.array([len(f) for f, _ in texts])
    at = np.concatenate([[0], np.cumsum(n)])
    rows = [at[:-1][n > t] + t for t in range(n[0])]
    k = x.shape[1]
    w = np.zeros(2 * k + 4 + 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    gold = np.zeros_like(w)
    for s in (0, 1):
        gold[s * k : (s + 1) * k] = x[y == s].sum(0)
        gold[2 * k + 4 + s] = (y[at[:-1]] == s).sum()
    inner = np.ones(len(y), bool)
    inner[at[:-1]] = False
    np.add.at(gold, 2 * k + 2 * y[np.flatnonzero(inner) - 1] + y[inner], 1)
    for i in range(1, rounds + 1):
        emit = x @ w[: 2 * k].reshape(2, k).T
        step, start = w[2 * k : 2 * k + 4].reshape(2, 2), w[2 * k + 4 :]
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[rows[0]] = start + emit[rows[0]]
        for r in rows[1:]:
            alpha[r] = np.logaddexp.reduce(alpha[r - 1][:, :, None] + step[None], axis=1) + emit[r]
        for r in rows[:0:-1]:
            beta[r - 1] = np.logaddexp.reduce(step[None] + (emit[r] + beta[r])[:, None, :], axis=2)
        z = np.repeat(np.logaddexp.reduce(alpha[at[1:] - 1], axis=1), n)
        p = np.exp(alpha + beta - z[:, None])
        expected = np.zeros_like(w)
        expected[: 2 * k] = (p.T @ x).ravel()
        expected[2 * k + 4 :] = p[at[:-1]].sum(0)
        j = np.flatnonzero(inner)
        if len(j):
            pair = alpha[j - 1][:, :, None] + step[None] + (emit[j] + beta[j])[:, None, :] - z[j][:, None, None]
            expected[2 * k : 2 * k + 4] = np.exp(pair).sum(0).ravel()
        grad = (gold - expected) / len(x) - 1e-4 * w
        if not linked:
            grad[2 * k :] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return LineField(w[: 2 * k].reshape(2, k), w[2 * k : 2 * k + 4].reshape(2, 2), w[2 * k + 4 :])


def fit_hidden(texts: list[tuple[np.ndarray, bool]]) -> LineField:
    """The field of (features, good) of one text each, by hard expectation maximisation; without both kinds, DEFAULT_FIELD."""
    texts = [t for t in texts if len(t[0])]
    if len({good for _, good in texts}) < 2:
        return DEFAULT_FIELD
    labels = [np.full(len(f), int(good)) for f, good in texts]
    bad = [i for i, (_, good) in enumerate(texts) if not good]
    x = np.concatenate([texts[i][0] for i in bad])
    at = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in bad])])
    for i in range(EM_ROUNDS):
        # the first labels change with the text only, so transitions learned from them would hold a text to one label
        linked = i >= UNLINKED_ROUNDS
        field = fit_field([(f, y) for (f, _), y in zip(texts, labels)], linked=linked)
        found = viterbi(field, x, at).astype(int)
        if linked and all((labels[j] == found[a:b]).all() for j, a, b in zip(bad, at[:-1], at[1:])) or found.all():
            break
        for j, a, b in zip(bad, at[:-1], at[1:]):
            labels[j] = found[a:b]
    return field


def train_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fit the field on at most TRAIN_DOCS labelled documents; without any, DEFAULT_FIELD.

    Executors measure the lines of these, so the driver gets features of a
    bounded number of lines and no text, in one job.
    """
    chosen = labels.where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_DOCS).select("doc_id", "quality").collect()
    quality = {str(r["doc_id"]): r["quality"] == 1 for r in chosen}
    if not quality:
        return DEFAULT_FIELD

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch.column(1)):
                found = measure(data, at)
                n = np.diff(found.line_at)
                skip = (mix(span_hashes(data, at[:-1], at[1:])) % np.maximum(1, n - TRAIN_LINES + 1).astype(np.uint64)).astype(np.int64)
                rows = [found.features[a + s : min(a + s + TRAIN_LINES, b)].astype("<f4").tobytes() for a, b, s in zip(found.line_at, found.line_at[1:], skip)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(rows, pa.binary())], names=["id", "lines"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isin(list(quality)))
    # rows that repeat an id are texts of their own, but no more than the bound in all
    found = rows.mapInArrow(lines, "id string, lines binary").orderBy("id", "lines").limit(2 * TRAIN_DOCS).collect()
    return fit_hidden([(np.frombuffer(r["lines"], "<f4").reshape(-1, len(FEATURES)).astype(float), quality[r["id"]]) for r in found])


MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines")]
    + [T.StructField("content_share", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def judge(data: np.ndarray, at: np.ndarray, field: LineField, min_share: float) -> dict[str, np.ndarray]:
    """The columns of MEASURES for the texts of a chunk."""
    m = measure(data, at)
    content = viterbi(field, m.features, m.line_at) == 1
    held = _prefix(np.where(content, m.line_words, 0))
    good = _prefix(content)
    share = (held[m.line_at[1:]] - held[m.line_at[:-1]]) / np.maximum(1, m.n_words)
    failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
    return {
        "n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines, "n_repeat_words": m.n_repeat_words,
        "n_lines": np.diff(m.line_at), "n_content_lines": good[m.line_at[1:]] - good[m.line_at[:-1]],
        "content_share": share, "base_failed": failed, "kept": ~failed & (share >= min_share),
    }


def label_lines(docs: DataFrame, field: LineField, text_col: str = "text", keep: list[str] | None = None, only_kept: bool = False, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The columns `keep` of each document and, unless `only_kept`, the columns of MEASURES.

    With `only_kept` the rejected documents go and the rest keep just `keep`.
    Null text counts as empty and fails the base rules; very long texts are
    measured and decoded whole; rows repeated in full are judged alike; of label
    sequences that tie, boilerplate goes first; columns keep their values
    whatever their names; an empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    chosen = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias(free_name(docs, "__text")))
    schema = T.StructType([docs.schema[c] for c in keep] + ([] if only_kept else list(MEASURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in chunks(batch.column(len(keep))):
                found = judge(data, at, field, min_share)
                part = batch.slice(first, last - first)
                columns = list(part.columns[: len(keep)])
                if only_kept:
                    out = pa.RecordBatch.from_arrays(columns, names=list(keep)).filter(pa.array(found["kept"]))
                else:
                    columns += [pa.array(found[f.name]) for f in MEASURES]
                    out = pa.RecordBatch.from_arrays(columns, names=[*keep, *MEASURES.names])
                if out.num_rows:
                    yield out

    return chosen.mapInArrow(run, schema)


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    field = train_field(docs, read_table(spark, sf_dir, "labels"))
    out = label_lines(docs, field, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_content_lines")
