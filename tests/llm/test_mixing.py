import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from veldt.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes, weights, total, cap):
    """Exact resharing: all open sources share by weight; those above their cap close."""
    target, left, open_ = [Fraction(0)] * len(sizes), min(Fraction(total), Fraction(cap) * sum(sizes)), [i for i, n in enumerate(sizes) if n]
    while open_:
        share = {i: left * Fraction(weights[i]) / sum(Fraction(weights[j]) for j in open_) for i in open_}
        full = [i for i in open_ if share[i] >= cap * sizes[i]]
        for i in full or open_:
            target[i] = Fraction(cap * sizes[i]) if full else share[i]
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return [float(t) for t in target]


@pytest.mark.parametrize("sizes", [[], [0], [5], [100, 1, 50, 7, 0, 900], [10] * 7])
def test_targets(sizes):
    weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = M.fill_targets(sizes, weights, 1.5 * sum(sizes), 2)
    assert np.allclose(got, brute_targets(sizes, [3, 1, 2] * 9, Fraction(3, 2) * sum(sizes), 2))
    assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 6), (1, 0, 1), (0, 9, 4), (40, 3, 30), (300, 900, 200), (2, 5000, 2500)])
def test_draws_are_hypergeometric(good, bad, draws):
    """Shares of every outcome are near the exact probabilities."""
    from math import comb

    rng, n = np.random.default_rng(good + draws), 20_000
    got = Counter(M.draw_without_replacement(rng, good, bad, draws) for _ in range(n))
    chi, cells = 0.0, 0
    for x in range(max(0, draws - bad), min(good, draws) + 1):
        want = n * comb(good, x) * comb(bad, draws - x) / comb(good + bad, draws)
        if want >= 5:
            chi, cells = chi + (got[x] - want) ** 2 / want, cells + 1
    assert sum(got.values()) == n and chi < cells + 5 * (2 * cells) ** 0.5 + 5


def test_draws_from_very_many():
    """Mean and deviation of draws from 10^12 slots."""
    rng = np.random.default_rng(1)
    got = np.array([M.draw_without_replacement(rng, 3 * 10**11, 7 * 10**11, 5 * 10**11) for _ in range(2000)], float)
    deviation = (5e11 * 0.3 * 0.7 * 0.5) ** 0.5
    assert abs(got.mean() - 1.5e11) < 5 * deviation / 2000**0.5 and abs(got.std() / deviation - 1) < 0.08
    assert M._split(rng, np.array([10**11, 0, 5, 9 * 10**11]), 10**12).sum() <= 10**12


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    for key in (1, 99):
        assert sorted(M.permute(np.arange(n), n, key)) == list(range(n))
    if n > 60:
        assert list(M.permute(np.arange(n), n, 1)) != list(M.permute(np.arange(n), n, 2))


@pytest.mark.parametrize("shards", [1, 2, 5, 13])
def test_draws_add_up(shards):
    totals = np.array([40, 0, 7, 100])
    found = [M.shard_draw(totals, shards, i, 3) for i in range(shards)]
    assert (sum(f[0] for f in found) == totals).all()
    for i, (_, before) in enumerate(found):
        assert (before == sum([f[0] for f in found[:i]], np.zeros(4, int))).all()


def test_mix(spark, documents, odd):
    df = documents.unionByName(odd.select(documents.columns).where("doc_id <> 7").withColumn("doc_id", M.F.col("doc_id") + 1_000_000))
    rows = {r["doc_id"]: r for r in df.collect()}
    plan = M.mix_sources(df)
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in rows.items()}
    assert {r["id"]: r["size"] for r in plan.placed.collect()} == size
    # streams are gapless within each source
    streams = defaultdict(list)
    for r in plan.placed.where("size > 0").collect():
        streams[r["source"]].append((r["start"], r["size"]))
    for own in streams.values():
        own.sort()
        assert [s for s, _ in own] == np.r_[0, np.cumsum([n for _, n in own])[:-1]].tolist()
    taken, at = Counter(), Counter()
    for r in M.mixed_shards(plan).collect():
        taken[r["id"]] += r["words"]
        at[(r["shard"], r["position"])] += r["words"]
    assert all(taken[i] <= 2 * n for i, n in size.items()) and max(at.values()) <= M.BLOCK_WORDS
    by_source = Counter()
    for i, n in taken.items():
        by_source[rows[i]["source"]] += n
    for s in plan.sources:
        assert abs(by_source[s["source"]] - s["target"]) <= 2 * M.BLOCK_WORDS
    # every block occurs once or twice, never in an epoch twice
    slots = Counter((r["rank"], r["block"], r["epoch"]) for r in plan.slots.collect())
    assert max(slots.values()) == 1
    # texts hold exactly the words taken, in whole where all are
    out = Counter()
    for r in M.mixed_documents(df, plan).collect():
        n = len(WORD.findall(r["text"]))
        out[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"]) and (n < size[r["doc_id"]] or r["text"] == rows[r["doc_id"]]["text"])
        words = WORD.findall(rows[r["doc_id"]]["text"])
        assert set(WORD.findall(r["text"])) <= set(words)
    assert out == taken


def test_reruns_agree(spark):
    d = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, M.op8_mix_sources(spark, d).repartition(n).collect())) for n in (1, 7))
    assert one == two
