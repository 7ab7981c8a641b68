"""Samplers, trees, semantic ids, retrieval and deltas."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldt.operators import configs, deltas, retrieval, sampling, trees
from veldt.operators import semantic_ids as S
from veldt.operators.features import IdFeature


@given(rows=st.integers(0, 200), workers=st.integers(1, 9))
def test_row_ranges(rows, workers):
    got = sampling.row_ranges(rows, workers)
    assert [i for a, b in got for i in range(a, b)] == list(range(rows)) and max(b - a for a, b in got) - min(b - a for a, b in got) <= 1


@given(rows=st.integers(0, 60), cuts=st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=5), workers=st.integers(1, 5))
def test_consumed_and_remaining_are_all(rows, cuts, workers):
    consumed = [(min(a, b), min(rows, max(a, b))) for a, b in cuts if min(a, b) < rows]
    left = sampling.remaining_ranges(rows, consumed)
    done = {i for a, b in consumed for i in range(a, b)}
    rest = [i for a, b in left for i in range(a, b)]
    assert sorted(done | set(rest)) == list(range(rows)) and not done & set(rest)
    dealt = sampling.redistribute(left, workers)
    assert [i for own in dealt for a, b in own for i in range(a, b)] == rest


def test_cost_batches(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate([3.0, 3.0, 3.0, 10.0, 1.0, 1.0])], "lane int, i int, c double")
    got = [r["batch"] for r in sampling.cost_batches(df, "i", "c", 6.0, "lane").orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3]


def test_negatives_avoid_positives(spark):
    positives = spark.createDataFrame([(u, i) for u in range(6) for i in range(u, 40 + u)], "u int, i int")
    items = spark.range(50).selectExpr("cast(id AS int) AS i")
    got = sampling.negative_sample(positives, items, "u", "i", 5).collect()
    known = {(r["u"], r["i"]) for r in positives.collect()}
    assert not {(r["u"], r["i"]) for r in got} & known and Counter(r["u"] for r in got) == {u: 5 for u in range(6)}


def test_negatives_follow_the_weights(spark):
    """First draws of many users against the weights of all items: chi-square, with one item of a third of all weight."""
    weights = [30.0, 20.0, *[float(w) for w in range(1, 9)], 4.0]
    items = spark.createDataFrame(list(enumerate([*weights, 0.0])), "i int, w double")
    users = spark.range(4000).selectExpr("id AS u", "cast(99 AS int) AS i")
    rows = sampling.negative_sample(users, items, "u", "i", 3, "w", seed=5).collect()
    assert Counter(r["u"] for r in rows) == {u: 3 for u in range(4000)} and len({(r["u"], r["i"]) for r in rows}) == 12000
    first, total = Counter(r["i"] for r in rows if r["rank"] == 1), sum(weights)
    assert sum((first[i] - 4000 * w / total) ** 2 / (4000 * w / total) for i, w in enumerate(weights)) < 30  # 10 degrees of freedom
    # the second of two draws without replacement
    want = sum(4000 * (w / total) * (30.0 / (total - w)) for i, w in enumerate(weights) if i)
    assert abs(Counter(r["i"] for r in rows if r["rank"] == 2)[0] - want) < 5 * want**0.5


def test_negatives_beside_a_heavy_item(spark):
    """One item has 99.9 % of the weight: who may draw it has it first nearly always, and all get their number, the rest evenly."""
    items = spark.createDataFrame([(i, 99_900.0 if i == 7 else 1.0) for i in range(101)], "i int, w double")
    positives = spark.createDataFrame([(u, 7 if u % 2 else 50 + u % 50) for u in range(3000)], "u int, i int")
    got = sampling.negative_sample(positives, items, "u", "i", 4, "w", seed=2).collect()
    own = {}
    for r in got:
        own.setdefault(r["u"], {})[r["rank"]] = r["i"]
    assert len(own) == 3000 and all(sorted(x) == [1, 2, 3, 4] and len(set(x.values())) == 4 for x in own.values())
    assert not any(7 in x.values() for u, x in own.items() if u % 2)
    assert sum(x[1] == 7 for u, x in own.items() if u % 2 == 0) >= 1480
    rest = Counter(i for u, x in own.items() if u % 2 for i in x.values())
    mean = sum(rest.values()) / 100
    assert sum((rest[i] - mean) ** 2 / mean for i in range(101) if i != 7) < 150  # chi-square of 99, beyond 0.1 %
    drawn = Counter(i for u, x in own.items() if u % 2 == 0 for i in x.values() if i != 7 and i < 50)
    mean = sum(drawn.values()) / 49
    assert sum((drawn[i] - mean) ** 2 / mean for i in range(50) if i != 7) < 86


def test_negatives_of_falling_weights(spark):
    """Each item has a hundred times the weight of the next: every round finds some, the order is that of weights nearly always."""
    items = spark.createDataFrame([(i, 100.0**-i) for i in range(12)], "i int, w double")
    positives = spark.createDataFrame([(u, u % 3) for u in range(90)], "u int, i int")
    got = sampling.negative_sample(positives, items, "u", "i", 9, "w", seed=1).collect()
    ordered = 0
    for u in range(90):
        own = [r["i"] for r in sorted((r for r in got if r["u"] == u), key=lambda r: r["rank"])]
        assert len(own) == 9 and len(set(own)) == 9 and u % 3 not in own
        ordered += own == sorted(own)
    assert ordered > 70


def test_negatives_where_positives_weigh_nearly_all(spark):
    items = spark.createDataFrame([(i, 1e9 if i < 3 else 1.0) for i in range(9)], "i int, w double")
    positives = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(8)], "u int, i int")
    got = Counter((r["u"], r["i"]) for r in sampling.negative_sample(positives, items, "u", "i", 4, "w").collect())
    assert set(got.values()) == {1} and {i for u, i in got if u == 1} < set(range(3, 9)) and sum(u == 1 for u, _ in got) == 4 and [i for u, i in got if u == 2] == [8]
    assert sampling.sample_size(9, 4) == 9 and sampling.sample_size(9, 4, False) == 4 and sampling.sample_size(9, None, False) == 9


@pytest.mark.parametrize("kind", ["UNIFORM", "ARITHMETIC", "RECIPROCAL"])
def test_kept_levels(spark, kind):
    """Exactly round(share * inner levels) and the last one, alike for all rows of a batch; later levels more often where chances rise."""
    rows = spark.range(2000).select("id", sampling.kept_levels(7, kind, 0.5, "id", seed=1).alias("l")).collect()
    assert all(len(set(r["l"])) == 4 and 7 in r["l"] for r in rows)
    seen = Counter(lv for r in rows for lv in r["l"])
    assert abs(seen[6] - 1000) < 150 if kind == "UNIFORM" else seen[6] > 1.4 * seen[1]
    one = spark.range(50).select(sampling.kept_levels(7, kind, 0.5, 0, seed=1).alias("l")).distinct().count()
    assert one == 1


@pytest.mark.parametrize("branches", [2, 3, 9, 10, 11])
def test_levels_in_whole_numbers(spark, branches):
    firsts, want = [], []
    code = 0
    for level in range(20):
        if code >= 2**62:
            break
        firsts += [code] + ([code - 1] if level else [])
        want += [level] + ([level - 1] if level else [])
        code = code * branches + 1
    got = [r["l"] for r in spark.createDataFrame(list(enumerate(firsts)), "i int, c long").orderBy("i").select(trees.level_of(F.col("c"), branches).alias("l")).collect()]
    assert got == want


def test_cells_reach_their_recall(spark):
    """The registered search in cells against all vectors."""
    from veldt.plans import index_queries as I

    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        best = {(r["query_id"], r["item_id"]) for r in I.QUERIES["top_k_inner_product"](spark, d).collect()}
        found = {(r["query_id"], r["item_id"]) for r in I.QUERIES["top_k_in_cells"](spark, d).collect()}
        assert len(best & found) >= 0.9 * len(best)


def test_weighted_sample_prefers_weight(spark):
    df = spark.range(1000).selectExpr("id AS i", "IF(id < 100, 50.0, 1.0) AS w")
    got = [r["i"] for r in sampling.weighted_sample(df, 100, "w", "i").collect()]
    assert len(set(got)) == 100 and sum(i < 100 for i in got) > 60


def test_tree_golden(spark):
    """Ten items of a binary tree: item ids, levels and the root's attributes."""
    leaves = spark.createDataFrame([(i, 7 + i if i < 8 else 15 + i, i, 0.1 * i) for i in range(10)], "item_id long, tree_code long, a int, r double")
    nodes = trees.build_tree(leaves, 2, ["a"], ["r"])
    levels = Counter(r["level"] for r in nodes.collect())
    assert levels[4] == 10 and levels[3] <= 8 and levels[0] == 1
    root = nodes.where("tree_code = 0").first()
    assert root["item_id"] == 10 and root["a"] == 0 and root["r"] == pytest.approx(0.45)


@pytest.mark.parametrize("branches", [2, 3])
def test_ancestors(spark, branches):
    codes = list(range(0, 200, 7)) + [10**12]
    got = {r["c"]: r["a"] for r in spark.createDataFrame([(c,) for c in codes], "c long").select("c", sampling.ancestors(F.col("c"), branches).alias("a")).collect()}
    for c in codes:
        want, x = [], c
        while x > 0:
            x = (x - 1) // branches
            want.append(x)
        assert got[c] == want


@pytest.mark.parametrize("n,branches", [(1, 2), (5, 2), (10, 3), (64, 2)])
def test_category_tree_has_a_leaf_for_each_item(spark, n, branches):
    df = spark.createDataFrame([(i, f"c{i % 3}") for i in range(n)], "i long, c string")
    rows = trees.category_tree(df, "i", "c", branches).collect()
    assert len({r["tree_code"] for r in rows}) == n
    order = [r["item_id"] for r in sorted(rows, key=lambda r: r["tree_code"])]
    assert order == sorted(range(n), key=lambda i: (f"c{i % 3}", i))


def test_cluster_tree_is_balanced(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(16)], "i long, v array<double>")
    codes = Counter(r["tree_code"] for r in trees.cluster_tree(df, "i", "v", 2).collect())
    assert len(codes) == 16
    for branches, n, limit in ((2, 16, 5), (2, 16, 1), (3, 25, 4)):
        some = df.unionByName(df.selectExpr("i + 16 AS i", "v")).where(F.col("i") < n)  # with repeated vectors
        big = trees.cluster_tree(some, "i", "v", branches, limit=limit).collect()
        top = trees.tree_depth(n, branches)
        assert len({r["tree_code"] for r in big}) == len(big) == n and {r["level"] for r in big} == {top}
        up = Counter((r["tree_code"] - 1) // branches for r in big)
        assert all(c <= branches for c in up.values())
    # two far groups are parted at the root, whether levels are split over the table or in a task
    far = spark.createDataFrame([(i, [float(100 * (i % 2)) + rng.random(), rng.random()]) for i in range(16)], "i long, v array<double>")
    for limit in (4, 100):
        halves = [{r["item_id"] % 2 for r in trees.cluster_tree(far, "i", "v", 2, limit=limit).collect() if (r["tree_code"] < 23) == first} for first in (True, False)]
        assert sorted(map(sorted, halves)) == [[0], [1]]
    label = trees.balanced_kmeans(rng.normal(size=(11, 2)), 3)
    assert sorted(Counter(label.tolist()).values()) == [3, 4, 4]


def test_exports_and_beam(spark):
    df = spark.createDataFrame([(i, "c", float(i)) for i in range(16)], "i long, c string, x double")
    leaves = trees.category_tree(df, "i", "c", 2).join(df.select(F.col("i").alias("item_id"), "x"), "item_id")
    nodes = trees.build_tree(leaves, 2, [], ["x"]).cache()
    assert trees.tree_edges(nodes, 2).count() == 16 * 3 and trees.predict_edges(nodes, 2).count() == 30
    assert trees.node_table(nodes, ["x"]).first()["id"] == -1 and trees.serving_tree(nodes).count() == 31
    queries = spark.createDataFrame([(1, 3.2), (2, 12.9)], "query_id int, w double")
    got = trees.beam_search(queries, nodes, 2, 2, lambda t: -F.abs(t["x"] - t["w"])).collect()
    assert {(r["query_id"], r["item_id"]) for r in got} == {(1, 3), (1, 4), (2, 13), (2, 12)}
    truth = spark.createDataFrame([(1, 3), (1, 9)], "query_id int, item_id long")
    assert trees.retrieval_recall(spark.createDataFrame(got), truth).first()[0] == 0.5


def test_tree_samples(spark):
    df = spark.createDataFrame([(i, "c") for i in range(16)], "i long, c string")
    nodes = trees.build_tree(trees.category_tree(df, "i", "c", 2), 2).select("item_id", "tree_code", "level")
    level = {r["tree_code"]: r["level"] for r in nodes.collect()}
    rows = sampling.tree_samples(spark.createDataFrame([(1, 3), (1, 4), (2, 9)], "u int, i long"), nodes, "u", "i", 2, {1: 1, 2: 2, 4: 5}).collect()
    positives = {(r["u"], r["i"], r["level"]): r["tree_code"] for r in rows if r["label"] == 1}
    assert len(positives) == 12
    negatives = [r for r in rows if r["label"] == 0]
    assert all(level[r["tree_code"]] == r["level"] and positives[r["u"], r["i"], r["level"]] != r["tree_code"] for r in negatives)
    assert len({(r["u"], r["i"], r["tree_code"]) for r in negatives}) == len(negatives)
    assert Counter(r["level"] for r in negatives) == {1: 3, 2: 6, 4: 15}


# --- semantic ids ------------------------------------------------------------------------

SIZES = [4, 8, 16]


def test_quality_golden(spark):
    codes = [[0, 0, 0]] * 3 + [[1, 1, 1], [1, 2, 2], [2, 3, 3], [3, 4, 4]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "item_id int, codes array<int>")
    q = S.quality(df, "codes", SIZES).first()
    assert (q["total"], q["unique_sids"], q["max_bucket"]) == (7, 5, 3)
    assert q["gini"] == pytest.approx((2 * (1 + 2 + 3 + 4 + 5 * 3) - 6 * 7) / (5 * 7))
    layers = S.layer_quality(df, "codes", SIZES).orderBy("layer").collect()
    assert [r["coverage"] for r in layers] == [1, 0.625, 0.3125] and [r["dead_codes"] for r in layers] == [0, 3, 11]


def test_gini_and_entropy_golden(spark):
    codes = [[k] for k, n in enumerate([3, 2, 1, 1, 1]) for _ in range(n)]
    q = S.quality(spark.createDataFrame([(c,) for c in codes], "codes array<int>"), "codes", [8]).first()
    assert q["gini"] == pytest.approx(0.25) and q["entropy"] == pytest.approx(1.4941751382893085)


def brute_resolve(items, sizes, capacity, draws):
    """One greedy pass over everything."""
    key = lambda c: tuple(c)
    buckets, over = {}, []
    for i, c, h in sorted(items, key=lambda x: (x[2], x[0])):
        own = buckets.setdefault(key(c), [])
        (own if len(own) < capacity else over).append((i, c, h))
    used, out = {k: len(v) for k, v in buckets.items()}, {i: c[-1] for v in buckets.values() for i, c, h in v}
    for i, c, h in sorted(over, key=lambda x: (x[1][-1], x[2], x[0])):
        for d in S.drawn_codes(h, sizes[-1], draws):
            if d != c[-1] and used.get((*c[:-1], d), 0) < capacity:
                break
        else:
            d = c[-1]
        used[(*c[:-1], d)] = used.get((*c[:-1], d), 0) + 1
        out[i] = d
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_collisions(spark, parts):
    rng = random.Random(3)
    items = [(i, [rng.randrange(2), rng.randrange(3)]) for i in range(40)]
    df = S.with_hash(spark.createDataFrame(items, "item_id long, codes array<int>").repartition(parts), "item_id")
    hashes = {r["item_id"]: r["item_hash"] for r in df.collect()}
    rows = S.resolve_collisions(df, "codes", [2, 3], 5, draws=2).collect()
    assert {r["item_id"]: r["resolved_last"] for r in rows} == brute_resolve([(i, c, hashes[i]) for i, c in items], [2, 3], 5, 2)
    slots = Counter((tuple(r["resolved_codes"]), r["slot"]) for r in rows)
    assert max(slots.values()) == 1 and all(r["moved"] == (r["codes"] != r["resolved_codes"]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_hot_bands_by_proposals(spark, seed):
    """Rounds of proposals place every item where placing one by one does, also with given candidates and published items."""
    rng = random.Random(seed)
    items = [(i, [rng.choice([0, 0, 0, 1]), min(rng.randrange(9), rng.randrange(9))], [[0, rng.randrange(9)] for _ in range(rng.randrange(5))]) for i in range(120)]
    df = S.with_hash(spark.createDataFrame(items, "item_id long, codes array<int>, candidate_codes array<array<int>>"), "item_id")
    prior = spark.createDataFrame([(k, rng.randrange(1, 6)) for k in range(0, 18, 4)], "key long, n long")
    for how in ({"draws": 6}, {"candidates": "candidate_codes", "draws": 3}, {"draws": 4, "prior": prior}):
        one_by_one, by_rounds = (sorted(map(str, S.resolve_collisions(df, "codes", [2, 9], 6, hot_band=h, **how).collect())) for h in (10**9, 5))
        assert one_by_one == by_rounds


def test_drawn_codes_golden(spark):
    rows = S.with_hash(spark.createDataFrame([(0,), (1,)], "item_id long"), "item_id").orderBy("item_id").collect()
    assert [S.drawn_codes(r["item_hash"], 4, n) for n in (3, 10) for r in rows] == [[1, 2, 0], [2, 0, 2]] * 2


def test_collision_golden(spark):
    codes = [[0, 0]] * 4 + [[0, 1]] + [[0, 2]] * 2 + [[1, 0]] * 3
    choice = {1: [0, 1, 2], 3: [1, 2, 3], 8: [0, 1, 2]}
    rows = [(i, c, [[c[0], k] for k in choice.get(i, [])]) for i, c in enumerate(codes)]
    df = S.with_hash(spark.createDataFrame(rows, "item_id long, codes array<int>, candidate_codes array<array<int>>"), "item_id")
    plan = S.collision_plan(df, "codes", [2, 4], 2, "item_hash")
    assert sorted(r["item_id"] for r in plan.where("overflow").collect()) == [1, 3, 8]
    got = S.resolve_collisions(df, "codes", [2, 4], 2, candidates="candidate_codes").orderBy("item_id").collect()
    assert [r["resolved_last"] for r in got] == [0, 1, 0, 3, 1, 2, 2, 0, 1, 0]
    assert [r["slot"] for r in got] == [2, 2, 1, 1, 1, 2, 1, 2, 1, 1]


def test_append_never_moves(spark):
    df = S.with_hash(spark.createDataFrame([(i, [i % 2, i % 3]) for i in range(30)], "item_id long, codes array<int>"), "item_id")
    old = S.resolve_collisions(df.where("item_id < 15"), "codes", [2, 3], 3, draws=2).select("item_id", "key", "slot")
    out = S.append_items(old, df, "codes", [2, 3], 3, draws=2)
    before = {r["item_id"]: (r["key"], r["slot"]) for r in old.collect()}
    groups = {r["key"]: r["item_ids"] for r in out["groups"].collect()}
    assert sorted(i for g in groups.values() for i in g) == list(range(30))
    assert all(groups[k][s - 1] == i for i, (k, s) in before.items())
    assert {r["key"] for r in out["delta"].collect()} == {r["key"] for r in out["resolved"].collect()}


def test_quantise_and_decode(spark):
    rng = np.random.default_rng(2)
    books = [rng.normal(size=(k, 4)).tolist() for k in (3, 5)]
    vectors = rng.normal(size=(20, 4))
    rows = S.quantise(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i int, embedding array<double>"), books, candidates=2).collect()
    for r in rows:
        left, want = vectors[r["i"]].copy(), []
        for book in books:
            d = ((np.array(book) - left) ** 2).sum(1)
            want.append(int(d.argmin()))
            order = np.argsort(d, kind="stable")
            left -= np.array(book)[want[-1]]
        assert r["codes"] == want and [c[-1] for c in r["candidate_codes"]] == order[:2].tolist()
    fitted = S.fit_codebooks(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i int, embedding array<double>"), [3, 2])
    assert [len(b) for b in fitted] == [3, 2]
    with pytest.raises(ValueError):
        S.fit_codebooks(spark.createDataFrame([(0, [1.0])], "i int, embedding array<double>"), [3])


def test_invalid_codes(spark):
    df = spark.createDataFrame([([0, 1],), ([0, 9],), ([0],), (None,), ([-1, 0],)], "codes array<int>")
    assert S.require_valid(df, "codes", [2, 3], drop=True).count() == 1
    with pytest.raises(Exception, match="invalid codes"):
        S.require_valid(df, "codes", [2, 3]).collect()


# --- retrieval and deltas ------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_top_k(spark, metric):
    rng = np.random.default_rng(3)
    q, v = rng.integers(-3, 4, (7, 5)).astype(float), rng.integers(-3, 4, (90, 5)).astype(float)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id int, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in retrieval.top_k(queries, items, 6, metric=metric).collect()}
    for i, x in enumerate(q):
        s = v @ x if metric == "ip" else -((v - x) ** 2).sum(1)
        assert [got[i, r + 1] for r in range(6)] == sorted(range(90), key=lambda j: (-s[j], j))[:6]
    assert retrieval.top_k(queries.limit(0), items, 3).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_in_batch_logits(spark, monkeypatch, block):
    """Batches above and below a block, repeated and null ids, a batch of one side, vectors of other widths or without an element."""
    monkeypatch.setattr(retrieval, "LOGIT_BLOCK", block)
    rng = np.random.default_rng(5)
    vec = lambda n=4: rng.integers(-3, 4, n).astype(float).tolist()
    users = [("a", i, vec()) for i in range(11)] + [("b", 1, vec()), ("b", 1, vec()), ("b", None, vec(2)), ("c", 5, vec()), (None, 6, vec())] + [(f"s{i}", i, vec()) for i in range(20)]
    items = [("a", i, vec()) for i in range(7)] + [("b", 2, vec()), ("b", 3, None), ("b", 4, [1.0, None, 0.0, 2.0]), ("b", 5, vec(2)), ("d", 5, vec()), (None, 6, vec())] + [(f"s{i}", -i, vec()) for i in range(20)]
    schema = "g string, {} int, embedding array<double>"
    got = retrieval.in_batch_logits(spark.createDataFrame(users, schema.format("user_id")), spark.createDataFrame(items, schema.format("item_id")), "g").collect()
    dot = lambda x, y: sum(p * q for p, q in zip(x, y)) if y and len(x) == len(y) and None not in y else None
    want = Counter((g, u, i, dot(x, y)) for g, u, x in users for h, i, y in items if g is not None and g == h)
    assert Counter(tuple(r) for r in got) == want


def test_in_batch_logits_of_whole_labels(spark):
    """The query pairs all vectors of a label, not those of pieces of it."""
    from veldt.plans import index_queries as I

    d = "/root/testdata/sf0.001"
    sizes = {r["label"]: r["count"] for r in spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").count().collect()}
    got = I.QUERIES["in_batch_logits"](spark, d)
    assert {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {g: n * n for g, n in sizes.items()}


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 4
    v = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id int, embedding array<double>")
    queries = items.where("item_id < 40").withColumnRenamed("item_id", "query_id")
    exact = {(r["query_id"], r["item_id"]) for r in retrieval.top_k(queries, items, 5).collect()}
    near = {(r["query_id"], r["item_id"]) for r in retrieval.top_k_in_cells(queries, items, 5, centres.tolist(), 3).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_reconcile(spark):
    local = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0])], "k int, embedding array<double>")
    remote = spark.createDataFrame([(1, [1.0, 2.0000001]), (2, [1.5])], "k int, embedding array<double>")
    assert {r["k"]: r["status"] for r in deltas.reconcile(local, remote, ["k"]).collect()} == {1: "MATCH", 2: "DIFFERENT", 3: "MISSING"}
    batches = deltas.upload_batches(local, ["k"], 1, 1).collect()
    assert sorted(r["batch"] for r in batches) == [0, 1, 2]


def test_configs(spark):
    info = spark.createDataFrame([("a", [1.0], None, ""), ("b", None, None, "DROP IT please"), ("c", None, 9, None)], "feature string, boundaries array<double>, hash_size int, message string")
    got = configs.with_info([IdFeature(n, ["user:x"]) for n in "abcd"], info)
    assert [f.name for f in got] == ["a", "c", "d"] and got[0].buckets.boundaries == [1.0] and got[1].buckets.hash_size == 9
    assert configs.without_dropped(info).count() == 2 and len(configs.request_sample(info, 2)) == 2


def test_cells_are_scored_in_blocks(spark, monkeypatch):
    """Each pair of blocks is a product of its own, no table holds a row for every pair; equal scores go by id, odd vectors have none."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 30)
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(size=(400, 4)), 1)
    centres = v[:5].tolist()
    rows = [(f"i{i:03}", x.tolist()) for i, x in enumerate(v)]
    items = spark.createDataFrame([*rows, ("odd", [1.0, None, 1.0, 1.0]), ("short", [1.0]), ("none", None), (None, [1.0] * 4)], "item_id string, embedding array<double>")
    queries = spark.createDataFrame(rows[:50], "query_id string, embedding array<double>")
    found = retrieval.top_k_in_cells(queries, items, 6, centres, 3, salts=2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    d = ((v[:, None] - np.array(centres)[None]) ** 2).sum(2)
    near = [sorted(range(5), key=lambda c: (x[c], c)) for x in d]
    want = set()
    for i in range(50):
        held = [j for j in range(400) if near[j][0] in near[i][:3]]
        best = sorted(held, key=lambda j: (-round(float(v[i] @ v[j]), 9), j))[:6]
        want |= {(rows[i][0], r + 1, round(float(v[i] @ v[j]), 9)) for r, j in enumerate(best)}
    assert {(r["query_id"], r["rank"], round(r["score"], 9)) for r in found.collect()} == want


def test_tree_samples_join_levels_with_negatives_only(spark):
    """Rows of the other levels, nearly all, meet nothing but their leaf; a small level is no shuffle of its rows."""
    nodes = spark.createDataFrame([(c - 14, c, 4) for c in range(15, 31)] + [(100 + c, c, [0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3][c]) for c in range(15)], "item_id long, tree_code long, level int")
    positives = spark.createDataFrame([(1, 3), (1, 4), (2, 9)], "u int, i long")
    plan = lambda negatives: sampling.tree_samples(positives, nodes, "u", "i", 2, negatives)._jdf.queryExecution().optimizedPlan().toString()
    assert plan({}).count("Join ") == plan({3: 0}).count("Join ") == 1
    some = plan({2: 2, 7: 1})
    assert some.count("Join ") == 5 and some.count("rightHint=(strategy=broadcast)") == 3
    rows = sampling.tree_samples(positives, nodes, "u", "i", 2, {2: 2, 7: 1}).collect()
    assert Counter((r["level"], r["label"]) for r in rows) == {(1, 1): 3, (2, 1): 3, (3, 1): 3, (4, 1): 3, (2, 0): 6}


def test_masked_pairs_travel_with_their_users(spark, monkeypatch):
    """Masking within the products gives what masking the table of all pairs gives, without a join of it."""
    monkeypatch.setattr(retrieval, "LOGIT_BLOCK", 8)
    rng = np.random.default_rng(12)
    rows = [(i % 3, f"n{i:02}", rng.normal(size=4).tolist() if i % 11 else None) for i in range(60)]
    users = spark.createDataFrame([(b, i, v) for b, i, v in rows], "b int, user_id string, embedding array<float>")
    items = users.withColumnRenamed("user_id", "item_id")
    masked = spark.createDataFrame([(rows[rng.integers(60)][1], rows[rng.integers(60)][1]) for _ in range(400)] + [("n00", "n00"), ("n03", None), ("none", "n03")], "user_id string, item_id string").distinct()
    found = retrieval.in_batch_logits(users, items, "b", masked=masked)
    want = retrieval.masked_logits(retrieval.in_batch_logits(users, items, "b"), masked, ["user_id", "item_id"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, (tuple(r) for r in want.select(found.columns).collect())))
    assert found.where("logit = -1e32").count() > 20 and found.count() == 1200
