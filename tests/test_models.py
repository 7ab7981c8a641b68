"""Dense models, routed interests and task weights against plain loops."""

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldt.__main__ import main
from veldt.operators import dense, interests, pareto, retrieval
from veldt.operators.sampling import uniform


def weight_rows(w):
    return [(name, i, [float(x) for x in row]) for name, m in w.items() for i, row in enumerate(np.atleast_2d(m))]


RNG = np.random.default_rng(4)
W = {
    "t.0.weight": RNG.normal(size=(5, 4)), "t.0.bias": RNG.normal(size=(1, 5)), "t.0.bn.mean": RNG.normal(size=(1, 5)), "t.0.bn.var": RNG.random((1, 5)), "t.0.bn.weight": RNG.normal(size=(1, 5)), "t.0.bn.bias": RNG.normal(size=(1, 5)),
    "t.1.weight": RNG.normal(size=(3, 5)), "t.1.ln.weight": RNG.normal(size=(1, 3)), "t.1.ln.bias": RNG.normal(size=(1, 3)),
    "c.0.weight": RNG.normal(size=(1, 4)), "c.0.bias": RNG.normal(size=(1, 4)), "c.1.weight": RNG.normal(size=(1, 4)), "c.1.bias": RNG.normal(size=(1, 4)),
    "d.0.u.weight": RNG.normal(size=(2, 4)), "d.0.v.weight": RNG.normal(size=(4, 2)), "d.0.v.bias": RNG.normal(size=(1, 4)),
    "m.expert.0.0.weight": RNG.normal(size=(2, 4)), "m.expert.1.0.weight": RNG.normal(size=(2, 4)), "m.gate_mlp.0.0.weight": RNG.normal(size=(3, 4)), "m.gate.0.weight": RNG.normal(size=(2, 3)), "m.gate.1.weight": RNG.normal(size=(2, 4)), "m.gate.1.bias": RNG.normal(size=(1, 2)),
    "s.0.weight": RNG.normal(size=(1, 2)), "s.1.weight": RNG.normal(size=(2, 1)),
}


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b))


def test_layers_against_loops():
    """Every layer for one row at a time, element by element."""
    for x in RNG.normal(size=(7, 4)):
        one = x[None]
        h = []
        for j in range(5):
            y = (dot(W["t.0.weight"][j], x) + W["t.0.bias"][0][j] - W["t.0.bn.mean"][0][j]) / math.sqrt(W["t.0.bn.var"][0][j] + 1e-5)
            h.append(max(0.0, y * W["t.0.bn.weight"][0][j] + W["t.0.bn.bias"][0][j]))
        z = [dot(row, h) for row in W["t.1.weight"]]
        mean = sum(z) / 3
        var = sum((y - mean) ** 2 for y in z) / 3
        z = [(y - mean) / math.sqrt(var + 1e-5) * g + b for y, g, b in zip(z, W["t.1.ln.weight"][0], W["t.1.ln.bias"][0])]
        assert np.allclose(dense.mlp(W, "t", one, last="sigmoid")[0], [1 / (1 + math.exp(-y)) for y in z])
        y = list(x)
        for i in range(2):
            s = dot(W[f"c.{i}.weight"][0], y)
            y = [a * s + b + c for a, b, c in zip(x, W[f"c.{i}.bias"][0], y)]
        assert np.allclose(dense.cross(W, "c", one)[0], y)
        narrow = [dot(row, x) for row in W["d.0.u.weight"]]
        assert np.allclose(dense.low_rank_cross(W, "d", one)[0], [a * (dot(row, narrow) + b) + a for a, row, b in zip(x, W["d.0.v.weight"], W["d.0.v.bias"][0])])
        assert np.allclose(dense.interactions(one, 4)[0], [a * b for a, b in itertools.combinations(x, 2)])
        assert np.allclose(dense.factorisation(one, 2)[0], [x[0] * x[2], x[1] * x[3]])
        found = dense.experts(W, "m", one)
        e = [[max(0.0, dot(row, x)) for row in W[f"m.expert.{k}.0.weight"]] for k in range(2)]
        hidden = [max(0.0, dot(row, x)) for row in W["m.gate_mlp.0.0.weight"]]
        for t, gate in enumerate([[dot(r, hidden) for r in W["m.gate.0.weight"]], [dot(r, x) + b for r, b in zip(W["m.gate.1.weight"], W["m.gate.1.bias"][0])]]):
            g = [math.exp(v) / sum(math.exp(q) for q in gate) for v in gate]
            assert np.allclose(found[t][0], [g[0] * e[0][j] + g[1] * e[1][j] for j in range(2)])
        means = [(x[0] + x[1] + x[2]) / 3, x[3]]
        a = max(0.0, dot(W["s.0.weight"][0], means))
        gates = [1 / (1 + math.exp(-W["s.1.weight"][j][0] * a)) for j in range(2)]
        assert np.allclose(dense.field_gates(W, "s", one, [3, 1])[0], [*(x[:3] * gates[0]), x[3] * gates[1]])


def test_score_and_job(spark, tmp_path):
    x = RNG.normal(size=(50, 4))
    rows = [(i, float(r[0]), [float(y) for y in r[1:]]) for i, r in enumerate(x)] + [(50, None, [0.0, None, 1.0])]
    df = spark.createDataFrame(rows, "id long, a double, rest array<double>").repartition(3)
    steps = [{"op": "cross", "name": "c", "in": ["a", "rest"], "out": "x"}, {"op": "mlp", "name": "t", "in": "x", "out": "h"}, {"op": "unit", "in": "h", "out": "user"}, {"op": "dot", "in": "user", "with": "h", "out": "sim"}]
    weights = dense.load_weights(spark.createDataFrame(weight_rows(W), dense.WEIGHTS).repartition(4))
    assert all(np.array_equal(weights[n], np.atleast_2d(m)) for n, m in W.items())
    out = {r["id"]: r for r in dense.score(df, steps, weights, ["sim", "user"], ["id"]).collect()}
    full = np.vstack([x, [0, 0, 0, 1]])
    h = dense.mlp(W, "t", dense.cross(W, "c", full))
    norm = np.maximum(np.linalg.norm(h, axis=1), 1e-12)
    for i in range(51):
        assert out[i]["sim"] == pytest.approx(norm[i] if norm[i] > 1e-12 else 0.0) and np.allclose(out[i]["user"], h[i] / norm[i])
    assert dense.score(df.limit(0), steps, weights, ["sim"], ["id"]).count() == 0
    with pytest.raises(ValueError, match="unknown step"):
        dense.score(df, [{"op": "magic", "in": "a", "out": "y"}], weights, ["y"])
    with pytest.raises(ValueError, match="numbered from 0"):
        dense.load_weights(spark.createDataFrame([("a", 1, [1.0])], dense.WEIGHTS))
    d = str(tmp_path)
    df.write.parquet(f"{d}/in.parquet")
    spark.createDataFrame(weight_rows(W), dense.WEIGHTS).write.parquet(f"{d}/weights.parquet")
    main(["predict-model", "--input", f"{d}/in.parquet", "--weights", f"{d}/weights.parquet", "--model", json.dumps(steps), "--outputs", "user,sim", "--reserved", "id", "--output", f"{d}/out.parquet"], spark)
    got = spark.read.parquet(f"{d}/out.parquet")
    assert got.columns == ["sim", "user", "id"] and got.count() == 51


def test_weights_are_refused_beyond_their_bound(spark, monkeypatch):
    monkeypatch.setattr(dense, "MAX_WEIGHT_BYTES", 100)
    with pytest.raises(ValueError, match="bytes of weights"):
        dense.load_weights(spark.createDataFrame(weight_rows(W), dense.WEIGHTS))


# --- interests ----------------------------------------------------------------------------


def routed(steps, projection, logits, k, rounds, scale, power, constant):
    low = [[sum(v[i] * projection[i][h] for i in range(len(v))) for h in range(len(projection[0]))] for v in steps]
    active = k if constant else math.ceil(max(1.0, min(float(k), math.log2(len(steps)))))
    unit = [[x / max(1e-12, math.sqrt(dot(v, v))) for x in v] for v in low]
    state = [list(row) for row in logits]
    for r in range(rounds):
        share = []
        for row in state:
            e = [math.exp(row[j] * scale) if j < active else 0.0 for j in range(k)]
            share.append([x / sum(e) for x in e])
        high = [[sum(share[s][j] * low[s][h] for s in range(len(low))) for h in range(len(low[0]))] for j in range(k)]
        state = [[share[s][j] + dot(high[j], unit[s]) for j in range(k)] for s in range(len(low))]
    out = []
    for j in range(active):
        n = max(1e-7, math.sqrt(dot(high[j], high[j])))
        out.append([(n * n / (1 + n * n)) ** power / n * x for x in high[j]])
    return out


@pytest.mark.parametrize("constant, scale, power", [(False, 1.0, 1.0), (True, 2.0, 0.5)])
def test_routing_against_loops(spark, constant, scale, power):
    projection = RNG.normal(size=(4, 3))
    users = [(f"u{i}", [[float(x) for x in RNG.normal(size=4)] for _ in range(n)]) for i, n in enumerate([1, 2, 3, 5, 9, 17, 40, 0])] + [("null", None)]
    df = spark.createDataFrame(users, "user_id string, steps array<array<double>>").repartition(3)
    got = {}
    how = dict(scale=scale, power=power, constant=constant, max_steps=20, seed=3)
    for r in interests.routed_interests(df, "steps", projection, 4, **how).orderBy("user_id", "interest").collect():
        got.setdefault(r["user_id"], []).append(r["embedding"])
        assert r["interest"] == len(got[r["user_id"]]) - 1
    drawn = spark.createDataFrame([(u, s, j) for u, _ in users for s in range(20) for j in range(4)], "u string, s int, j int")
    from pyspark.sql import functions as F

    draws = drawn.select("u", "s", "j", uniform("u", "s", "j", 0, seed=3).alias("a"), uniform("u", "s", "j", 1, seed=3).alias("b"))
    normal = {(r["u"], r["s"], r["j"]): math.sqrt(-2 * math.log(r["a"])) * math.cos(2 * math.pi * r["b"]) for r in draws.withColumn("x", F.lit(1)).collect()}
    want = {u: routed(v[:20], projection, [[normal[u, s, j] for j in range(4)] for s in range(len(v[:20]))], 4, 3, scale, power, constant) for u, v in users if v}
    assert got.keys() == want.keys()
    for u, v in want.items():
        assert np.allclose(got[u], v, atol=1e-9)
    if not constant:
        assert [len(got[f"u{i}"]) for i in range(7)] == [1, 1, 2, 3, 4, 4, 4]
    with pytest.raises(Exception, match="must have 4 numbers"):
        interests.routed_interests(spark.createDataFrame([("a", [[1.0]])], "user_id string, steps array<array<double>>"), "steps", projection, 2).collect()


def test_interests_feed_retrieval(spark):
    """Interests are queries of their own and their results one list of the user."""
    users = spark.createDataFrame([(i, [[float(x) for x in RNG.normal(size=3)] for _ in range(8)]) for i in range(6)], "user_id long, steps array<array<double>>")
    v = RNG.normal(size=(60, 3))
    items = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "item_id long, embedding array<double>")
    found = interests.routed_interests(users, "steps", np.eye(3), 3)
    queries = interests.interest_queries(found)
    near = retrieval.top_k(queries, items, 5).join(queries.select("query_id", "user_id"), "query_id")
    merged = retrieval.merge_interests(near.select(near["user_id"].alias("query_id"), "item_id", "score"), 5).collect()
    own = {}
    for r in found.collect():
        own.setdefault(r["user_id"], []).append(r["embedding"])
    for i in range(6):
        best = (np.array(own[i]) @ v.T).max(0)
        assert [r["item_id"] for r in sorted((r for r in merged if r["query_id"] == i), key=lambda r: r["rank"])] == np.lexsort((np.arange(60), -best))[:5].tolist()


# --- task weights -------------------------------------------------------------------------


def test_gram(spark):
    g = RNG.normal(size=(200, 3))
    g[5, 1] = 0
    rows = [(float(a), None if i == 5 else float(b), float(c)) for i, (a, b, c) in enumerate(g)]
    assert np.allclose(pareto.gram(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]), g.T @ g)
    blocks = [([float(x) for x in g[i : i + 7, 0]], [float(x) for x in g[i : i + 7, 2]]) for i in range(0, 200, 7)]
    assert np.allclose(pareto.gram(spark.createDataFrame(blocks, "a array<double>, c array<double>"), ["a", "c"]), (g.T @ g)[[0, 2]][:, [0, 2]])
    assert not pareto.gram(spark.createDataFrame([], "a double, b double"), ["a", "b"]).any()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6), st.booleans())
def test_weights_are_on_the_simplex(k, seed, dependent):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(k, 9)) * 10.0 ** rng.integers(-3, 4)
    if dependent and k > 1:
        g[-1] = g[0]
    least = rng.random(k) / (2 * k)
    w = pareto.pareto_weights(g @ g.T, least.tolist())
    assert w.sum() == pytest.approx(1) and (w >= least - 1e-9).all()


def test_two_tasks_have_the_shortest_sum():
    """For two tasks a search over all weights finds none better."""
    rng = np.random.default_rng(9)
    for _ in range(50):
        g = rng.normal(size=(2, 6))
        least = [0.1, 0.2]
        w = pareto.pareto_weights(g @ g.T, least)
        tried = [np.linalg.norm(a * g[0] + (1 - a) * g[1]) for a in np.linspace(0.1, 0.8, 400)]
        assert np.linalg.norm(w @ g) <= min(tried) + 1e-6


def test_simplex_is_the_nearest_point():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.normal(size=4)
        p = pareto.on_simplex(x, 0.7)
        assert p.min() >= 0 and p.sum() == pytest.approx(0.7)
        for _ in range(200):
            q = rng.dirichlet(np.ones(4)) * 0.7
            assert np.linalg.norm(p - x) <= np.linalg.norm(q - x) + 1e-9


def test_bad_least_weights():
    for least in ([0.5, 0.5], [-0.1, 0.2], [0.9]):
        with pytest.raises(ValueError):
            pareto.pareto_weights(np.eye(2), least)
