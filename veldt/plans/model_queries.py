"""Queries that score tables with given weights, route interests, weigh tasks and publish deltas, each beside its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, interests, pareto
from ..sources.session import scratch
from ..streaming import managed, publish
from .feature_queries import table
from .index_queries import u
from .metric_queries import rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _rows_of(spark, d, last: int) -> DataFrame:
    """The first vectors of the embeddings, whose elements serve as given weights."""
    return table(spark, d, "embeddings", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(F.col("vec_id") <= last)


def _weights(rows: DataFrame, places: dict[str, list[int]], width: int) -> DataFrame:
    """The table (name, i, v) of matrices whose rows are the starts of the named vectors."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(name, i, vec) for name, own in places.items() for i, vec in enumerate(own)], "name string, i int, vec_id long")
    return rows.join(F.broadcast(named), "vec_id").select("name", "i", F.slice("v", 1, width).alias("v"))


# --- dense models -----------------------------------------------------------------------


@query("dense_two_layers", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id <= 6),
w AS (SELECT list(v[1:3] ORDER BY vec_id) FILTER (vec_id < 4) AS w0, any_value(v[1:4]) FILTER (vec_id = 4) AS b0, any_value(v[1:4]) FILTER (vec_id = 5) AS w1, any_value(v[1]) FILTER (vec_id = 6) AS b1 FROM e),
h AS (SELECT l_orderkey, l_linenumber, [greatest(0, list_dot_product([l_quantity::DOUBLE / 50, l_discount::DOUBLE, l_tax::DOUBLE], w0[j]) + b0[j]) FOR j IN range(1, 5)] AS h, w1, b1 FROM lineitem, w)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(list_dot_product(h, w1) + b1))), 6) AS probs FROM h""")  # fmt: skip
def _(spark, d):
    rows = _rows_of(spark, d, 6)
    table_of = _weights(rows, {"tower.0.weight": [0, 1, 2, 3]}, 3).unionByName(_weights(rows, {"tower.0.bias": [4], "tower.1.weight": [5]}, 4)).unionByName(_weights(rows, {"tower.1.bias": [6]}, 1))
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    steps = [{"op": "mlp", "name": "tower", "in": ["quantity", "discount", "tax"], "out": "probs", "last": "sigmoid"}]
    return rounded(dense.score(li, steps, dense.load_weights(table_of), ["probs"], ["l_orderkey", "l_linenumber"]))


_V = ", ".join(f"any_value(embedding[1:2]::DOUBLE[]) FILTER (vec_id = {i}) AS v{i}" for i in range(10, 24))


@query("dense_experts", f"""
WITH w AS (SELECT {_V} FROM embeddings),
x AS (SELECT p_partkey, [p_size::DOUBLE / 50, p_retailprice::DOUBLE / 1000] AS x, w.* FROM part, w),
a AS (SELECT *, [x[i] * list_dot_product(x, v10) + v11[i] + x[i] FOR i IN [1, 2]] AS a FROM x),
b AS (SELECT *, [x[i] * list_dot_product(a, v12) + v13[i] + a[i] FOR i IN [1, 2]] AS b FROM a),
e AS (SELECT *, [greatest(0, list_dot_product(b, v14)), greatest(0, list_dot_product(b, v15))] AS e0, [greatest(0, list_dot_product(b, v16)), greatest(0, list_dot_product(b, v17))] AS e1,
  exp(list_dot_product(b, v18)) AS s0, exp(list_dot_product(b, v19)) AS s1, exp(list_dot_product(b, v20)) AS t0, exp(list_dot_product(b, v21)) AS t1 FROM b)
SELECT p_partkey, round(list_dot_product(v22, [(s0 * e0[i] + s1 * e1[i]) / (s0 + s1) FOR i IN [1, 2]]), 6) AS click, round(list_dot_product(v23, [(t0 * e0[i] + t1 * e1[i]) / (t0 + t1) FOR i IN [1, 2]]), 6) AS buy
FROM e""")  # fmt: skip
def _(spark, d):
    """Two cross layers, two experts and a gate for each of two tasks."""
    places = {
        "cross.0.weight": [10], "cross.0.bias": [11], "cross.1.weight": [12], "cross.1.bias": [13], "mix.expert.0.0.weight": [14, 15], "mix.expert.1.0.weight": [16, 17],
        "mix.gate.0.weight": [18, 19], "mix.gate.1.weight": [20, 21], "click.weight": [22], "buy.weight": [23],
    }
    steps = [
        {"op": "cross", "name": "cross", "in": ["size", "price"], "out": "x"}, {"op": "experts", "name": "mix", "in": "x", "out": ["a", "b"]},
        {"op": "linear", "name": "click", "in": "a", "out": "click"}, {"op": "linear", "name": "buy", "in": "b", "out": "buy"},
    ]
    part = table(spark, d, "part", "p_partkey", (F.col("p_size") / 50).cast("double").alias("size"), (F.col("p_retailprice") / 1000).cast("double").alias("price"))
    return rounded(dense.score(part, steps, dense.load_weights(_weights(_rows_of(spark, d, 23), places, 2)), ["click", "buy"], ["p_partkey"]))


# --- interests ----------------------------------------------------------------------------

K, ROUNDS, STEPS = 3, 3, 12


def _draw(n: int) -> str:
    return u(f"user_id::VARCHAR || '|' || s::VARCHAR || '|' || j::VARCHAR || '|{n}'")


def _routing_sql() -> str:
    parts = [f"""
WITH ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s FROM events QUALIFY s < {STEPS}),
n AS (SELECT user_id, ceil(greatest(1, least({K}, log2(count(*))))) AS active FROM ev GROUP BY user_id),
low AS (SELECT user_id, s, h, sum(e.embedding[i]::DOUBLE * p.embedding[4 + h]::DOUBLE * 3) AS x
  FROM ev JOIN embeddings e ON e.vec_id = event_id % 500, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 4)) AS h), embeddings p WHERE p.vec_id = i - 1 GROUP BY ALL),
dir AS (SELECT user_id, s, h, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, s)) AS x FROM low),
l0 AS (SELECT user_id, s, j, sqrt(-2 * ln({_draw(0)})) * cos(2 * pi() * {_draw(1)}) AS l FROM ev JOIN n USING (user_id), (SELECT unnest(range({K})) AS j) WHERE j < active)"""]
    for r in range(ROUNDS):
        parts.append(f"""
a{r} AS (SELECT user_id, s, j, exp(l) / sum(exp(l)) OVER (PARTITION BY user_id, s) AS a FROM l{r}),
h{r} AS (SELECT user_id, j, h, sum(a * x) AS x FROM a{r} JOIN low USING (user_id, s) GROUP BY ALL),
l{r + 1} AS (SELECT user_id, s, j, any_value(a) + sum(h{r}.x * dir.x) AS l FROM a{r} JOIN h{r} USING (user_id, j) JOIN dir USING (user_id, s, h) GROUP BY ALL)""")
    last = f"h{ROUNDS - 1}"
    parts.append(f"""
z AS (SELECT user_id, j, h, x, sqrt(sum(x * x) OVER (PARTITION BY user_id, j)) AS n FROM {last})""")
    return ",".join(parts) + """
SELECT user_id, j::INT AS interest, h::BIGINT AS element, round(n * n / (1 + n * n) / n * x, 6) AS x FROM z"""


@query("routed_interests", _routing_sql())
def _(spark, d):
    e = table(spark, d, "events", "user_id", "event_id").withColumn("vec_id", F.col("event_id") % 500)
    vectors = _rows_of(spark, d, 499).select("vec_id", F.slice("v", 1, 4).alias("v"))
    histories = e.join(vectors, "vec_id").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "v"))), lambda s: s["v"]).alias("steps"))
    projection = np.array([r["v"][4:7] for r in _rows_of(spark, d, 3).orderBy("vec_id").collect()]) * 3
    found = interests.routed_interests(histories, "steps", projection, K, ROUNDS, STEPS)
    return rounded(found.select("user_id", "interest", F.posexplode("embedding").alias("element", "x")).withColumn("element", (F.col("element") + 1).cast("long")), 6)


# --- tasks --------------------------------------------------------------------------------


@query("pareto_weights", """
WITH g AS (SELECT l_quantity::DOUBLE / 50 - 0.3 AS x, l_discount::DOUBLE * 10 - 0.2 AS y FROM lineitem),
m AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c FROM g),
w AS (SELECT greatest(0, least(0.7, -((a - b) * 0.1 + (b - c) * 0.2 + (b - c) * 0.7) / ((a - b) - (b - c)))) AS w FROM m)
SELECT 'x' AS task, round(w + 0.1, 6) AS weight FROM w UNION ALL SELECT 'y', round(0.7 - w + 0.2, 6) FROM w""")  # fmt: skip
def _(spark, d):
    g = table(spark, d, "lineitem", (F.col("l_quantity").cast("double") / 50 - 0.3).alias("x"), (F.col("l_discount").cast("double") * 10 - 0.2).alias("y"))
    return rounded(pareto.pareto_table(g, ["x", "y"], [0.1, 0.2]))


# --- publication --------------------------------------------------------------------------


@query("delta_publication", """
SELECT event_type AS feature_name, user_id AS key_id, max(event_id) AS global_step, max_by(value, event_id) AS value, min(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) = 0 AS known_early
FROM events GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """Three batches out of order; one is killed before its commit and run again, one is repeated, and the table is compacted between."""
    rows = table(spark, d, "events", F.col("event_type").alias("feature_name"), F.col("user_id").alias("key_id"), F.col("event_id").alias("global_step"), "value")
    path, keys = scratch(spark), ["feature_name", "key_id"]
    batch = lambda i: rows.where(F.col("global_step") % 3 == i)

    def killed(stored: DataFrame, now: int) -> None:
        raise InterruptedError("between write and commit")

    publish.publish_batch(batch(0), 0, path, keys, clock=lambda: 1000)
    try:
        publish.publish_batch(batch(2), 1, path, keys, attempts=2, clock=lambda: 900, send=killed)
    except InterruptedError:
        pass
    early = publish.published(spark, path, keys).select(*keys, F.lit(True).alias("early"))
    publish.publish_batch(batch(2), 1, path, keys, clock=lambda: 900)
    publish.compact(spark, path, keys)
    publish.publish_batch(batch(0), 0, path, keys)
    publish.publish_batch(batch(1), 2, path, keys, clock=lambda: 950)
    out = publish.published(spark, path, keys).join(early, keys, "left")
    return out.select(*keys, "global_step", "value", F.coalesce("early", F.lit(False)).alias("known_early"))


@query("managed_ids_stream", """
WITH RECURSIVE e AS (SELECT user_id AS id, event_id // 50 + 1 AS step FROM events WHERE event_id % 5 <> 2 OR user_id % 2 = 0),
s AS (SELECT id, ceil(step / 20.0)::BIGINT AS seg, count(*) AS cnt, max(step) AS last_step FROM e GROUP BY ALL),
m AS (SELECT max(step) AS last FROM e),
g AS (SELECT 0::BIGINT AS seg, [NULL::STRUCT(id BIGINT, cnt BIGINT, last_step BIGINT)][:0] AS held
  UNION ALL SELECT seg + 1, list_slice(list_sort(list_transform(grown, lambda x: {'worth': -x.cnt / pow(least((seg + 1) * 20, last) - x.last_step + 1, 0.5), 'id': x.id, 'cnt': x.cnt, 'last_step': x.last_step})), 1, CASE WHEN (seg + 1) * 20 <= last THEN 40 ELSE 1000000 END).list_transform(lambda x: {'id': x.id, 'cnt': x.cnt, 'last_step': x.last_step})
  FROM (SELECT seg, last, list_concat(
      list_filter(held, lambda h: NOT list_contains(ids, h.id)),
      list_transform(new, lambda x: {'id': x.id, 'cnt': (x.cnt + coalesce(list_sum(list_transform(list_filter(held, lambda h: h.id = x.id), lambda h: h.cnt)), 0))::BIGINT, 'last_step': x.last_step})) AS grown
    FROM g JOIN (SELECT seg AS next, list({'id': id, 'cnt': cnt, 'last_step': last_step}) AS new, list(id) AS ids FROM s GROUP BY seg) n ON n.next = g.seg + 1, m))
SELECT h.id, h.cnt, h.last_step FROM (SELECT unnest(held) AS h FROM g WHERE seg = (SELECT max(seg) FROM g))""")  # fmt: skip
def _(spark, d):
    """Three batches, one of them given twice, with evictions every 20 steps; an id that was evicted counts anew."""
    e = table(spark, d, "events", F.col("user_id").alias("key"), "event_id").where("event_id % 5 <> 2 or key % 2 = 0").select("key", (F.floor(F.col("event_id") / 50) + 1).alias("step"))
    path, last = scratch(spark), e.agg(F.max("step")).first()[0]
    for number, (low, high) in enumerate([(0, last // 3), (last // 3, last // 2), (last // 3, last // 2), (last // 2, last)]):
        part = e.where((F.col("step") > low) & (F.col("step") <= high))
        managed.manage_batch(part, min(number, 1) if number < 3 else 2, path, "key", "step", 40, 20, policy="distance_lfu", decay=0.5)
    return managed.managed_table(spark, path)
