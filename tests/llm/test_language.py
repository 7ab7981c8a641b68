import zlib

import numpy as np
import pyarrow as pa

from veldt.llm import byte_cnn as C
from veldt.llm.textops import utf8


def toy():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(120):
        k = int(rng.integers(0, 2))
        words = ["the", "thing", "that"] if k else ["der", "die", "schön"]
        texts.append(" ".join(rng.choice(words, 40)))
        labels.append(k)
    return texts, labels


def slow_log_probabilities(net, grid):
    """Filters slid by loops."""
    out = []
    for row in grid:
        feats = []
        for table, bias in zip(net.tables, net.biases):
            w = len(table)
            h = np.array([sum(table[j][row[i + j]] for j in range(w)) for i in range(C.WINDOW - w + 1)]) + bias
            feats.append(h.max(0))
        z = np.maximum(np.concatenate(feats), 0) @ net.out + net.out_bias
        out.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
    return np.array(out)


def test_training_and_inference():
    texts, labels = toy()
    parts = [C.windows_of(t.encode(), 3) for t in texts]
    net = C.train_net(np.concatenate(parts), np.repeat(labels, [len(p) for p in parts]), ["de", "en"])
    assert np.allclose(C.log_probabilities(net, parts[0]), slow_log_probabilities(net, parts[0]), atol=1e-3)
    best, score = C.predict(net, *utf8(pa.array([*texts, "", "x", "é" * 700])))
    assert (best[: len(texts)] == labels).mean() > 0.98 and ((0 <= score) & (score <= 1)).all()
    # a text's prediction does not depend on what stands around it
    alone = [C.predict(net, *utf8(pa.array([t])))[1][0] for t in texts[:5]]
    assert np.allclose(alone, score[:5])


def test_held_out_accuracy_and_fold(spark):
    d = "/root/testdata/sf0.01"
    rows = C.op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_und_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = C.train_on(df.where("doc_id <> 4"), C.F.lit(True))
    assert net is None
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in C.identify(df, net, ["doc_id"]).collect()}
    assert out == {i: ("und", 0.0) for i in range(1, 5)}
