import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")


from veldt.llm import line_crf as Q
from veldt.llm.textops import utf8

TEXTS = ["", "a a a a", "x\n\nx\n x", "é\x0bb", "one two three one two three", "same\nsame\nsame \nother", "日本 語\n日本 語", "#1 | two < 3 > & %", "a\n" * 40, "w " * 60]


def brute(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = set()
    for j in range(len(w) - 2):
        if tri[tuple(w[j : j + 3])] > 1:
            covered |= {j, j + 1, j + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_counts(documents):
    texts = TEXTS + [r["text"] for r in documents.select("text").collect()]
    m = Q.measure(*utf8(pa.array([*texts, None])))
    got = list(zip(*(x.tolist() for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words))))
    assert got == [brute(t) for t in [*texts, ""]]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        field = Q.LineField(rng.normal(size=(2, 10)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 10))

        def value(path):
            e = x @ field.emit.T
            return field.start[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:]))

        best = max(([(k >> i) & 1 for i in range(n)] for k in range(2**n)), key=value)
        # with other texts around it
        got = Q.viterbi(field, np.concatenate([x[:1], x, x]), np.array([0, 1, 1, 1 + n, 1 + 2 * n]))
        assert got[1 : 1 + n].tolist() == best == got[1 + n :].tolist()


def test_training_gradient_and_fit():
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(60):
        y = (np.cumsum(rng.random(12) < 0.2) % 2).astype(int)
        f = rng.normal(size=(12, 10)) * 0.3
        f[:, 2] += 2 * (1 - y)
        texts.append((f, y))
    field = Q.fit_field(texts)
    found = [Q.viterbi(field, f, np.array([0, len(f)])) for f, _ in texts]
    assert np.mean([np.mean(a == y) for a, (_, y) in zip(found, texts)]) > 0.95
    assert Q.fit_field([(f, np.ones(12, int)) for f, _ in texts]) is Q.DEFAULT_FIELD


def test_verdict_follows_labels(spark):
    """Good labelled documents stay unless the base rules reject them; most bad ones go."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = Q.train_field(docs, labels)
    rows = Q.label_lines(docs, field, keep=["doc_id"]).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.98
    assert np.mean([r["kept"] for r in bad]) < 0.2


def test_hidden_labels_are_found():
    """Bad texts are content with boilerplate between: their lines are told apart though none is labelled."""
    rng = np.random.default_rng(3)
    texts, truth = [], []
    for i in range(200):
        good = i % 4 > 0
        y = np.ones(12, int) if good else (np.arange(12) // 3 % 2)
        f = rng.normal(size=(12, 10)) * 0.3
        f[:, 0] = 1
        f[:, 2] += 2 * (1 - y)
        texts.append((f, good))
        truth.append(y)
    field = Q.fit_hidden(texts)
    found = [Q.viterbi(field, f, np.array([0, len(f)])) for f, _ in texts]
    assert np.mean([np.mean(a == y) for a, y in zip(found, truth)]) > 0.95
    assert Q.fit_hidden([t for t in texts if t[1]]) is Q.DEFAULT_FIELD


@pytest.mark.parametrize("text", ["", None])
def test_no_labels(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train_field(docs, labels) is Q.DEFAULT_FIELD
