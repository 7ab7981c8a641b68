import math
import re
from collections import Counter

import pytest

from veldt.llm import cross_entropy as C

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, target, share):
    words = {i: WORD.findall((t or "").translate(LOW)) for i, t in texts.items()}
    counts, in_target = Counter(), Counter()
    for i, w in words.items():
        counts.update(w)
        if i in target:
            in_target.update(w)
    n, nt = sum(counts.values()), sum(in_target.values())
    least = max(2, math.ceil(share * n))
    vocabulary = {w for w, c in counts.items() if c >= least}
    pairs, target_pairs = Counter(), Counter()
    for i, w in words.items():
        own = [p for p in zip(w, w[1:]) if p[0] in vocabulary and p[1] in vocabulary]
        pairs.update(own)
        if i in target:
            target_pairs.update(own)
    kept = {p for p, c in pairs.items() if c >= least}
    out = {}
    for i, w in words.items():
        known = [x if x in vocabulary else None for x in w]
        own, own_pairs = Counter(known), Counter(p for p in zip(known, known[1:]) if p[0] and p[1])
        means = []
        for single, double, total, on in ((in_target, target_pairs, nt, i in target), (counts, pairs, n, True)):
            unknown = total - sum(single[x] for x in vocabulary)
            count = lambda x: (single[x] if x else unknown) - own[x] * on  # noqa: B023, E731
            loss = 0.0
            for k, x in enumerate(known):
                p = (count(x) + C.PSEUDO_COUNT) / (total - len(w) * on + C.PSEUDO_COUNT * (len(vocabulary) + 1))
                before = known[k - 1] if k else None
                if x and before and count(before) > 0:
                    both = double[before, x] - own_pairs[before, x] * on if (before, x) in kept else 0
                    p = C.BIGRAM_WEIGHT * both / count(before) + (1 - C.BIGRAM_WEIGHT) * p
                loss -= math.log(p)
            means.append(loss / max(1, len(w)))
        out[i] = (len(w), *means)
    return out


@pytest.mark.parametrize("share", [C.SHARE, 1e-3])
@pytest.mark.parametrize("some", [True, False])
def test_scores(spark, documents, odd, share, some):
    df = documents.select("doc_id", "text").limit(60).unionByName(odd.where("doc_id <> 7").selectExpr("doc_id + 1000000 AS doc_id", "text")).cache()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    target = set(list(texts)[::3]) if some else set()
    ids = spark.createDataFrame([(i,) for i in [*target, None, -5]], "id long")
    want = brute(texts, target, share)
    for r in C.score(df, ids, share=share).collect():
        n, a, b = want[r["doc_id"]]
        assert r["n_tokens"] == n and math.isclose(r["ce_target"], a, abs_tol=1e-8) and math.isclose(r["ce_background"], b, abs_tol=1e-8)
        assert math.isclose(r["ce_diff"], a - b, abs_tol=1e-8)
    df.unpersist()


def test_target_like_documents_score_lower(spark):
    rows = [(i, "alpha beta gamma delta " * 20) for i in range(10)] + [(i, "omega psi chi phi " * 20) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["ce_diff"] for r in C.score(df, df.where("doc_id < 5").selectExpr("doc_id AS id")).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 20))


def test_rare_words_count_at_any_size(spark):
    """A word and a bigram of few occurrences among three million tokens are modelled, not one unknown word."""
    rows = [(i, "common words fill this line " * 6000) for i in range(100)] + [(i, "zyx wvu common words") for i in range(100, 102)] + [(i, "lone%d tsr common words" % i) for i in range(102, 104)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.score(df, df.where("doc_id = 100").selectExpr("doc_id AS id")).collect()}
    want = brute({i: t for i, t in rows}, {100}, 0.0)
    for i, r in got.items():
        assert r["n_tokens"] == want[i][0] and math.isclose(r["ce_target"], want[i][1], rel_tol=1e-9) and math.isclose(r["ce_background"], want[i][2], rel_tol=1e-9)
    share = brute({i: t for i, t in rows}, {100}, 2.0**-20)
    assert abs(share[101][1] - want[101][1]) > 0.1 and abs(share[102][2] - want[102][2]) > 0.1
