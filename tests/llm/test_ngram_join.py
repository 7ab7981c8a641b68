import itertools
import random
import re

import numpy as np
import pytest

from veldt.llm import components
from veldt.llm import ngram_join as N
from veldt.llm.components import connected_components
from veldt.llm.session import prepare

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed=1):
    """Families of near copies at every similarity, chains, passages that many share, ties and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(300))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for family in range(8):
        base = [word() for _ in range(rng.choice([6, 20, 80, 200]))]
        current = base
        for _ in range(9):
            current = list(current if family % 2 else base)
            for _ in range(rng.randrange(0, max(2, len(current) // 20))):
                current[rng.randrange(len(current))] = word()
            text = current + (passage if family % 3 == 0 else [])
            rows.append((n, " ".join(text)))
            n += 1
    for t in ["", None, "one", "ONE", "one two", "a b c d", "a b c d", "a b c d e", "  a  b c\nd e"]:
        rows.append((n, t))
        n += 1
    return rows


@pytest.mark.parametrize("block_tokens,cell_tokens", [(N.BLOCK_TOKENS, N.CELL_TOKENS), (N.BLOCK_TOKENS, 150), (400, 100), (150, 150)])
def test_components(spark, monkeypatch, block_tokens, cell_tokens):
    """Also with blocks so small that they go by leaders and cells."""
    monkeypatch.setattr(N, "CELL_TOKENS", cell_tokens)
    rows = variants()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_join(df, block_tokens=block_tokens).collect()}
    assert got == brute(rows)


def bridged(seed, families, copies, length=400, step=48):
    """Families of near copies at places of a chain: neighbours on it link, others don't; single texts bridge some gaps."""
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(length)]

    def at(place, copy):
        words = list(base)
        for p in range(place):
            words[p * step : (p + 1) * step] = [f"p{p}y{i}" for i in range(step)]
        return words if copy is None else words[:-1] + [f"c{place}z{copy}"]

    rows, place = [], 0
    for _ in range(families):
        rows += [at(place, c) for c in range(copies)]
        gap = rng.choice([2, 3])
        if rng.random() < 0.7:
            rows += [at(place + g, None) for g in range(1, gap)]
        place += gap
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_bridges_between_leaders_families(spark):
    """Two families of 110 near copies and a path of two texts between them, at the limits of production: one component."""
    base = [f"w1x{i}" for i in range(400)]
    change = lambda p, w: w[: p * 48] + [f"p{p}y{i}" for i in range(48)] + w[(p + 1) * 48 :]
    a = change(0, base)
    b = change(1, a)
    far = change(2, b)
    texts = [base[:-1] + [f"c{i}"] for i in range(110)] + [far[:-1] + [f"d{i}"] for i in range(110)] + [a, b]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sum(len(t) - 4 for t in texts) > N.CELL_TOKENS
    got = {r["id"]: r["component_id"] for r in N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 222


@pytest.mark.parametrize("seed", range(4))
def test_random_bridges(spark, monkeypatch, seed):
    monkeypatch.setattr(N, "CELL_TOKENS", 2_000)
    rows = bridged(seed, 4, 9, length=500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_join(df, block_tokens=random.Random(seed).choice([4_000, N.BLOCK_TOKENS])).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [50, 90])
def test_other_thresholds(spark, percent):
    rows = variants(2)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute(rows, percent)


def test_trie_finds_all_links():
    rng = np.random.default_rng(4)
    for percent in (30, 75, 100):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
        sets += [sets[0], sets[1][:-1] if len(sets[1]) > 1 else sets[1]]
        sizes = [len(s) for s in sets]
        got = dict(N._roots(N.link_block(list(range(len(sets))), sizes, sets, percent)))
        group = list(range(len(sets)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= percent * (sizes[a] + sizes[b] - o) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
        assert {i: got.get(i, i) for i in range(len(sets))} == dict(enumerate(group))


def test_connected_components(spark):
    prepare(spark)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)] + [(5, 5), (777, 777), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in group}


@pytest.mark.parametrize("forest_edges", [4, 60])
def test_connected_components_of_many_tasks(spark, monkeypatch, forest_edges):
    """Stars of several tasks, over fewer and fewer tasks or with rounds after them; loops beside and within components."""
    prepare(spark)
    monkeypatch.setattr(components, "FOREST_EDGES", forest_edges)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000, 2000 + i) for i in range(1, 40)] + [(5, 5), (777, 777), (1003, 1003), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    one = {r["node"]: r["component"] for r in connected_components(df, "a", "b", 1).collect()}
    assert one[1030] == 1000 and one[2039] == 2000 and one[777] == 777 and len(one) == len({x for e in edges if e[0] is not None for x in e})
    assert {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()} == one
    assert {r["node"]: r["component"] for r in connected_components(df, "a", "b", len(edges)).collect()} == one


def test_components_in_few_jobs(spark):
    """A path of 300 nodes, which takes many rounds, is no more jobs for the driver than a single edge."""
    prepare(spark)
    spark.sparkContext.setJobGroup("few-jobs", "")
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(299)], "a long, b long"), "a", "b", 300).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 300 and {r["component"] for r in got} == {0} and len(jobs) <= 6
