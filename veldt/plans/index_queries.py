"""Queries over samplers, retrieval, trees, semantic ids and deltas, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import configs, deltas, dense, retrieval, sampling, trees, vector_index
from ..operators import semantic_ids as S
from ..sources.session import scratch
from .feature_queries import table
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


def u(parts: str, seed: int = 0) -> str:
    """SQL of sampling.uniform."""
    return f"((('0x' || substr(md5('{seed}|' || {parts}), 1, 12))::BIGINT + 0.5)::DOUBLE / 281474976710656.0)"


# --- sampling ---------------------------------------------------------------------------


@query("sample_mask", f"SELECT o_orderkey FROM orders WHERE {u('o_orderkey::VARCHAR', 3)} < 0.25")
def _(spark, d):
    return table(spark, d, "orders", "o_orderkey").where(sampling.sample_mask(0.25, "o_orderkey", seed=3))


@query("weighted_sample", f"SELECT p_partkey FROM part WHERE p_size > 0 ORDER BY ln({u('p_partkey::VARCHAR', 5)}) / p_size DESC, p_partkey LIMIT 100")
def _(spark, d):
    return sampling.weighted_sample(table(spark, d, "part", "p_partkey", "p_size"), 100, "p_size", "p_partkey", seed=5).select("p_partkey")


def _bought(spark, d) -> DataFrame:
    o, li = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))


BOUGHT = "WITH b AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("negative_sample", BOUGHT + f""",
it AS (SELECT p_partkey AS item_id, p_size::DOUBLE AS w, sum(p_size::DOUBLE) OVER (ORDER BY substr(md5(p_partkey::VARCHAR), 1, 4), p_partkey) AS high FROM part WHERE p_size > 0),
c AS (SELECT item_id, high - w AS low FROM it),
dr AS (SELECT user_id, j, {u("user_id::VARCHAR || '|' || j::VARCHAR", 7)} * (SELECT max(high) FROM it) AS x FROM (SELECT DISTINCT user_id FROM b), (SELECT unnest(range(1, 241)) AS j)),
h AS (SELECT user_id, item_id, min(j) AS j FROM dr ASOF JOIN c ON dr.x >= c.low GROUP BY ALL)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rank FROM h ANTI JOIN b USING (user_id, item_id) QUALIFY rank <= 5""")  # fmt: skip
def _(spark, d):
    items = table(spark, d, "part", F.col("p_partkey").alias("item_id"), "p_size")
    return sampling.negative_sample(_bought(spark, d), items, "user_id", "item_id", 5, "p_size", seed=7).withColumn("rank", F.col("rank").cast("long"))


@query("hard_negatives", """
WITH h AS (SELECT o_custkey AS user_id, l_partkey AS item_id, max(l_extendedprice) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, item_id) AS rank FROM h) WHERE rank <= 3""")  # fmt: skip
def _(spark, d):
    o, li = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    hard = o.join(li.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_extendedprice").alias("w"))
    return sampling.hard_negatives(_bought(spark, d), hard, "user_id", "item_id", 3, "w").withColumn("rank", F.col("rank").cast("long"))


@query("fixed_batches", """
WITH b AS (SELECT user_id, event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 16)::BIGINT AS batch, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, batch FROM b WHERE (batch + 1) * 16 <= n""")  # fmt: skip
def _(spark, d):
    return sampling.fixed_batches(table(spark, d, "events", "user_id", "event_id"), "event_id", 16, "user_id", True)


@query("cost_batches", """
WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, value, i, 0::BIGINT AS batch, value AS total FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.value, o.i, r.batch + (r.total + o.value > 400)::BIGINT, CASE WHEN r.total + o.value > 400 THEN o.value ELSE r.total + o.value END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, event_id, value, batch FROM r""")  # fmt: skip
def _(spark, d):
    return sampling.cost_batches(table(spark, d, "events", "user_id", "event_id", "value"), "event_id", "value", 400.0, "user_id")


@query("reservoir_sample", f"SELECT event_id FROM events ORDER BY {u('event_id::VARCHAR', 2)}, event_id LIMIT 200")
def _(spark, d):
    return sampling.reservoir(table(spark, d, "events", "event_id"), 200, "event_id", seed=2)


@query("flatten_positives", BOUGHT + " SELECT user_id, item_id FROM b")
def _(spark, d):
    lists = _bought(spark, d).groupBy("user_id").agg(F.collect_set("item_id").alias("items"))
    return sampling.flatten_positives(lists, "items", "item_id")


# --- retrieval ----------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding")


@query("top_k_inner_product", """
SELECT query_id, item_id, round(score, 5) AS score, rank FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id) AS rank
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")  # fmt: skip
def _(spark, d):
    v = _vectors(spark, d)
    out = retrieval.top_k(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), 10)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), 5)


@query("top_k_l2", """
SELECT query_id, item_id, round(score, 5) AS score FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) ** 2 AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS rank
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id) WHERE rank <= 5""")  # fmt: skip
def _(spark, d):
    v = _vectors(spark, d)
    out = retrieval.top_k(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), 6, metric="l2")
    return rounded(out.where("query_id <> item_id").select("query_id", "item_id", F.greatest("score", F.lit(0.0)).alias("score")), 5)


@query("hit_rate", """
WITH k AS (SELECT query_id, item_id FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, i.vec_id) AS rank
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0) WHERE rank <= 10),
t AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 100 = 0)
SELECT round((SELECT count(*) FROM k JOIN t USING (query_id, item_id))::DOUBLE / (SELECT count(*) FROM t), 6) AS hitrate""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    truth = q.select("query_id", "label").join(e.select("label", "vec_id"), "label").groupBy("query_id").agg(F.collect_set("vec_id").alias("gt_items"))
    found = retrieval.top_k(q, e.withColumnRenamed("vec_id", "item_id"), 10)
    return rounded(retrieval.hit_rate(retrieval.hit_details(found, truth)))


@query("merge_interests", """
WITH k AS (SELECT q.label AS query_id, i.vec_id AS item_id, max(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[])) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, item_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM k) WHERE rank <= 8""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "embeddings")
    found = retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "item_id"), 8)
    groups = e.select(F.col("vec_id").alias("query_id"), F.col("label"))
    merged = retrieval.merge_interests(found.join(groups, "query_id").select(F.col("label").alias("query_id"), "item_id", "score"), 8)
    return rounded(merged.withColumn("rank", F.col("rank").cast("long")), 5)


# the sample that cells are made of: the 16 vectors whose ids have the least md5
CENTRES = "(SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS c, embedding::DOUBLE[] AS cv FROM embeddings ORDER BY md5(vec_id::VARCHAR) LIMIT 16)"
#: Probed cells of 16: the given vectors have no clusters, so a recall of 0.9 takes most of them (see test_cells_reach_their_recall).
PROBES = 13


def _centres(spark, d) -> list[list[float]]:
    least = F.md5(F.col("vec_id").cast("string").cast("binary"))
    return [list(map(float, r["embedding"])) for r in _vectors(spark, d).orderBy(least).limit(16).collect()]


@query("inverted_file_cells", f"""
SELECT vec_id, c::INT AS cell FROM (SELECT e.vec_id, c, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(embedding::DOUBLE[], cv), c) AS r FROM embeddings e, {CENTRES}) WHERE r = 1""")  # fmt: skip
def _(spark, d):
    return retrieval.assign_cells(_vectors(spark, d).withColumn("embedding", vectors.doubles(F.col("embedding"))), _centres(spark, d)).select("vec_id", "cell")


@query("top_k_in_cells", f"""
WITH a AS (SELECT e.vec_id, embedding::DOUBLE[] AS v, c, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(embedding::DOUBLE[], cv), c) AS r FROM embeddings e, {CENTRES}),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_dot_product(q.v, i.v) AS score FROM a q JOIN a i ON q.c = i.c WHERE q.r <= {PROBES} AND i.r = 1 AND q.vec_id % 100 = 0)
SELECT query_id, item_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p) WHERE rank <= 10""")  # fmt: skip
def _(spark, d):
    v = _vectors(spark, d)
    out = retrieval.top_k_in_cells(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), 10, _centres(spark, d), PROBES)
    return rounded(out.drop("rank"), 5)


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, d)
    return v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id")


def _stored_index(spark, items: DataFrame, cells: int, metric: str, links: int) -> vector_index.VectorIndex:
    """An index that was built, saved and loaded again."""
    path = scratch(spark)
    vector_index.build_index(items, vector_index.fit_cells(items, cells, rounds=4), metric, links=links).save(path, "1")
    return vector_index.VectorIndex.load(spark, path, "1")


@query("vector_index_exact", """
SELECT query_id, item_id, round(score, 5) AS score, rank, n AS scored FROM (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) ** 2 AS score, count(*) OVER (PARTITION BY q.vec_id) AS n,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS rank
  FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id) WHERE rank <= 10""")  # fmt: skip
def _(spark, d):
    """All cells of a fitted index, each scored whole: no item is lost in building, saving, loading or merging."""
    q, items = _sides(spark, d)
    found = vector_index.search(_stored_index(spark, items, 8, "l2", 0), q, 11, 8).where("query_id <> item_id")
    return rounded(found.select("query_id", "item_id", "score", (F.col("rank") - 1).cast("long").alias("rank"), (F.col("scored") - 1).alias("scored")), 5)


@query("vector_index_recall", "SELECT count(*) FILTER (vec_id % 100 = 0) AS n_queries, count(*) AS n_items, true AS recall_reached, true AS quarter_read FROM embeddings")
def _(spark, d):
    """Walks of the graphs against the exact neighbours: 0.9 of them by scoring a quarter of the items at most."""
    q, items = _sides(spark, d)
    index = _stored_index(spark, items, vector_index.cell_count(items.count()), "ip", vector_index.LINKS)
    found = vector_index.search(index, q, 10, len(index.centres), beam=12)
    exact = retrieval.top_k(q, items, 10).select("query_id", "item_id")
    recall = exact.join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    read = found.groupBy("query_id").agg(F.max("scored").alias("scored")).agg(F.count("*").alias("n_queries"), F.avg("scored").alias("scored"))
    size = index.blocks.agg(F.sum("n").alias("n_items"))
    one = recall.crossJoin(read).crossJoin(size)  # one row each
    return one.select("n_queries", "n_items", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") * 4 <= F.col("n_items")).alias("quarter_read"))


@query("embedding_pooling", """
WITH f AS (SELECT label AS g, vec_id AS id FROM embeddings), x AS (SELECT g, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS v FROM f JOIN embeddings ON vec_id = id)
SELECT g, round(sum(s) FILTER (p <= 4), 5) AS first_four, round(sum(s), 4) AS total FROM (SELECT g, p, avg(v) AS s FROM x GROUP BY ALL) GROUP BY g""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "embeddings")
    ids = e.groupBy(F.col("label").alias("g")).agg(F.collect_list("vec_id").alias("ids"))
    pooled = retrieval.embedding_pool(ids, e.select(F.col("vec_id").alias("id"), vectors.doubles(F.col("embedding")).alias("embedding")), "g", "ids", "mean")
    return pooled.select("g", F.round(vectors.total(F.slice("embedding", 1, 4)), 5).alias("first_four"), F.round(vectors.total(F.col("embedding")), 4).alias("total"))


@query("in_batch_logits", """
SELECT a.label AS batch, a.vec_id AS user_id, b.vec_id AS item_id, round(CASE WHEN a.vec_id = b.vec_id THEN -1e32 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 5) AS logit
FROM embeddings a JOIN embeddings b ON a.label = b.label""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("label", "batch")
    same = e.select(F.col("vec_id").alias("user_id"), F.col("vec_id").alias("item_id"))
    out = retrieval.in_batch_logits(e.withColumnRenamed("vec_id", "user_id"), e.withColumnRenamed("vec_id", "item_id"), "batch", masked=same)
    return rounded(out.select("batch", "user_id", "item_id", "logit"), 5)


# --- semantic ids ---------------------------------------------------------------------------

SIZES = [4, 8, 16]


def _coded(spark, d) -> DataFrame:
    """Codes from the first elements of the embeddings, each cut into as many parts as its layer has codes."""
    cut = lambda i, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("embedding")[i].cast("double") + 0.3) / 0.6 * n))).cast("int")
    return _vectors(spark, d).select(F.col("vec_id").alias("item_id"), F.array(*[cut(i, n) for i, n in enumerate(SIZES)]).alias("codes"))


_CODE = "least({1}, greatest(0, floor((embedding[{0}]::DOUBLE + 0.3) / 0.6 * {2})))::BIGINT"
CODED = f"WITH c AS (SELECT vec_id AS item_id, {_CODE.format(1, 3, 4)} AS a, {_CODE.format(2, 7, 8)} AS b, {_CODE.format(3, 15, 16)} AS c FROM embeddings), k AS (SELECT *, (a * 8 + b) * 16 + c AS key FROM c)"


@query("sid_quality", CODED + """,
g AS (SELECT key, count(*)::DOUBLE AS x, row_number() OVER (ORDER BY count(*), key) AS i FROM k GROUP BY key)
SELECT sum(x)::BIGINT AS total, count(*) AS unique_sids, round(count(*) / sum(x), 6) AS no_collision_rate, round(avg((x = 1)::INT), 6) AS singleton_rate, max(x)::BIGINT AS max_bucket,
  round(sum((2 * i - (SELECT count(*) FROM g) - 1) * x) / (count(*) * sum(x)), 6) AS gini, round(ln(sum(x)) - sum(x * ln(x)) / sum(x), 6) AS entropy,
  round(ln(512), 6) AS max_entropy, round((ln(sum(x)) - sum(x * ln(x)) / sum(x)) / ln(512), 6) AS entropy_ratio
FROM g""")  # fmt: skip
def _(spark, d):
    return rounded(S.quality(_coded(spark, d), "codes", SIZES))


@query("sid_layer_quality", CODED + """,
l AS (SELECT 0 AS layer, a AS code, 4 AS n FROM k UNION ALL SELECT 1, b, 8 FROM k UNION ALL SELECT 2, c, 16 FROM k), g AS (SELECT layer, code, n, count(*)::DOUBLE AS x FROM l GROUP BY ALL)
SELECT layer, round(count(*)::DOUBLE / any_value(n), 6) AS coverage, (any_value(n) - count(*))::BIGINT AS dead_codes, round(exp(ln(sum(x)) - sum(x * ln(x)) / sum(x)), 6) AS perplexity FROM g GROUP BY layer""")  # fmt: skip
def _(spark, d):
    return rounded(S.layer_quality(_coded(spark, d), "codes", SIZES))


@query("sid_top_buckets", CODED + " SELECT key AS sid_key, count(*) AS count, [any_value(a), any_value(b), any_value(c)]::INT[] AS codes FROM k GROUP BY key ORDER BY count(*) DESC, key LIMIT 15")
def _(spark, d):
    return S.top_buckets(_coded(spark, d), "codes", SIZES, 15)


@query("sid_keys", CODED + " SELECT item_id, key, [a, 4 + b, 12 + c]::INT[] AS shifted FROM k WHERE c < 12")
def _(spark, d):
    ok = S.require_valid(_coded(spark, d), "codes", [4, 8, 12], drop=True)
    return ok.select("item_id", S.mixed_radix(F.col("codes"), SIZES).alias("key"), S.offset_codes(F.col("codes"), SIZES).alias("shifted"))


@query("residual_quantise", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
o AS (SELECT e.vec_id, c::INT AS c, list_transform(list_zip(v, cv), lambda p: p[1] - p[2]) AS r, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(v, cv), c) AS n FROM e, {CENTRES}),
t AS (SELECT o.vec_id, o.c AS first, k.c::INT AS second, list_distance(r, cv) AS dist, row_number() OVER (PARTITION BY o.vec_id ORDER BY list_distance(r, cv), k.c) AS n FROM o, {CENTRES} k WHERE o.n = 1)
SELECT vec_id, [first, second] AS codes, round(dist, 5) AS error FROM t WHERE n = 1""")  # fmt: skip
def _(spark, d):
    books = [_centres(spark, d)] * 2
    q = S.quantise(_vectors(spark, d), books)
    gap = F.zip_with(vectors.doubles(F.col("embedding")), S.decode(F.col("codes"), books), lambda a, b: a - b)
    return q.select("vec_id", "codes", F.round(vectors.norm(gap), 5).alias("error"))


_TWO64 = "18446744073709551616::UHUGEINT"


@query("sid_collisions", CODED.replace("WITH", "WITH RECURSIVE", 1) + f""",
y0 AS (SELECT item_id, a * 8 + b AS band, c AS last, [a, b, c]::INT[] AS codes, key, (item_id::UHUGEINT + {S.HASH_SEED * S.SPLITMIX_STEP % 2**64}::UHUGEINT) % {_TWO64} AS z FROM k),
y1 AS (SELECT * REPLACE ((xor(z, z >> 30) * {S.SPLITMIX_FACTORS[0]}::UHUGEINT) % {_TWO64} AS z) FROM y0),
y2 AS (SELECT * REPLACE ((xor(z, z >> 27) * {S.SPLITMIX_FACTORS[1]}::UHUGEINT) % {_TWO64} AS z) FROM y1),
y AS (SELECT * REPLACE (xor(z, z >> 31) AS z) FROM y2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z, item_id) > 2 AS overflow FROM y),
w0 AS (SELECT item_id, i, (z + i * {S.SPLITMIX_STEP}::UHUGEINT + {S.HASH_SEED * S.SPLITMIX_STEP % 2**64}::UHUGEINT) % {_TWO64} AS v FROM r, (SELECT unnest(range(6))::UHUGEINT AS i) WHERE overflow),
w1 AS (SELECT item_id, i, (xor(v, v >> 30) * {S.SPLITMIX_FACTORS[0]}::UHUGEINT) % {_TWO64} AS v FROM w0),
w2 AS (SELECT item_id, i, (xor(v, v >> 27) * {S.SPLITMIX_FACTORS[1]}::UHUGEINT) % {_TWO64} AS v FROM w1),
w AS (SELECT item_id, list((xor(v, v >> 31) % 16)::INT ORDER BY i) AS choice FROM w2 GROUP BY item_id),
o AS (SELECT band, last, item_id, choice, row_number() OVER (PARTITION BY band ORDER BY last, z, item_id) AS i FROM r JOIN w USING (item_id)),
f AS (SELECT band, last, count(*) AS n FROM r WHERE NOT overflow GROUP BY ALL),
u AS (SELECT band, list(coalesce(n, 0) ORDER BY last) AS used FROM (SELECT DISTINCT band FROM o) CROSS JOIN (SELECT unnest(range(16)) AS last) LEFT JOIN f USING (band, last) GROUP BY band),
g AS (SELECT band, 0::BIGINT AS i, used, NULL::BIGINT AS item_id, NULL::INT AS target FROM u
  UNION ALL SELECT band, i, [used[x + 1] + (x = target)::INT FOR x IN range(16)], item_id, target FROM (
    SELECT g.band, o.i, g.used, o.item_id, coalesce(list_filter(o.choice, lambda x: x <> o.last AND g.used[x + 1] < 2)[1], o.last)::INT AS target FROM g JOIN o ON o.band = g.band AND o.i = g.i + 1)),
d AS (SELECT r.*, coalesce(g.target, r.last)::INT AS resolved_last FROM r LEFT JOIN g ON g.item_id = r.item_id)
SELECT item_id, codes, [codes[1], codes[2], resolved_last] AS resolved_codes, resolved_last, row_number() OVER (PARTITION BY band, resolved_last ORDER BY overflow, CASE WHEN overflow THEN last END, z, item_id)::INT AS slot,
  resolved_last <> last AS moved, band * 16 + resolved_last AS key FROM d""")  # fmt: skip
def _(spark, d):
    items = S.with_hash(_coded(spark, d), "item_id")
    return S.resolve_collisions(items, "codes", SIZES, 2, draws=6)


@query("sid_append")
def _(spark, d):
    items = S.with_hash(_coded(spark, d), "item_id")
    old = S.resolve_collisions(items.where("item_id % 2 = 0"), "codes", SIZES, 2, draws=6).select("item_id", "key", "slot")
    return S.append_items(old, items, "codes", SIZES, 2, draws=6)["groups"]


def _report_sql(key: str, most: int) -> str:
    """SQL of the quality of codes with a joined number `key`, `most` of which there can be, as (metric, value)."""
    return f"""
SELECT unnest(['total', 'unique_sids', 'no_collision_rate', 'singleton_rate', 'max_bucket', 'gini', 'entropy', 'max_entropy', 'entropy_ratio']) AS metric,
  unnest([sum(x), count(*), count(*) / sum(x), avg((x = 1)::INT), max(x), (2 * sum(i * x) - (max(m) + 1) * sum(x)) / (count(*) * sum(x)), ln(sum(x)) - sum(x * ln(x)) / sum(x), ln({most}), (ln(sum(x)) - sum(x * ln(x)) / sum(x)) / ln({most})]::DOUBLE[]) AS value
FROM (SELECT x, row_number() OVER (ORDER BY x)::DOUBLE AS i, count(*) OVER () AS m FROM (SELECT count(*)::DOUBLE AS x FROM f GROUP BY {key}))"""


@query("sid_quality_report", CODED + f""",
f AS (SELECT key AS k1, (a * 8 + b) * 16 + c // 2 AS k2 FROM k), one AS ({_report_sql("k1", 512)}), two AS ({_report_sql("k2", 512)})
SELECT 'before' AS view, metric, round(value, 6) AS value FROM one UNION ALL SELECT 'after', metric, round(value, 6) FROM two
UNION ALL SELECT 'delta', metric, round(two.value - one.value, 6) FROM one JOIN two USING (metric)""")  # fmt: skip
def _(spark, d):
    both = _coded(spark, d).withColumn("after", F.concat(F.slice("codes", 1, 2), F.array(F.floor(F.col("codes")[2] / 2).cast("int"))))
    return rounded(S.quality_report(both, "codes", SIZES, "after"))


# --- trees --------------------------------------------------------------------------------


def _category_tree(spark, d) -> DataFrame:
    return trees.category_tree(table(spark, d, "part", "p_partkey", "p_type"), "p_partkey", "p_type", 2)


TREE = """WITH RECURSIVE p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_type, p_partkey) - 1 AS place, count(*) OVER () AS n FROM part),
dp AS (SELECT greatest(1, ceil(log2(max(n)) - 1e-9)::INT) AS depth FROM p),
t AS (SELECT p_partkey, place, 0::BIGINT AS low, n AS high, 0::BIGINT AS code, 0 AS level FROM p
  UNION ALL SELECT p_partkey, place,
    CASE WHEN place < low + (high - low) // 2 THEN low ELSE low + (high - low) // 2 END, CASE WHEN place < low + (high - low) // 2 THEN low + (high - low) // 2 ELSE high END,
    code * 2 + CASE WHEN place < low + (high - low) // 2 THEN 1 ELSE 2 END, level + 1 FROM t, dp WHERE level < depth)"""


@query("category_tree", TREE + " SELECT p_partkey AS item_id, code AS tree_code, level FROM t, dp WHERE level = depth")
def _(spark, d):
    return _category_tree(spark, d)


@query("tree_nodes", TREE + """
SELECT level, count(DISTINCT code) AS nodes, sum(DISTINCT code)::BIGINT AS code_sum FROM t GROUP BY level""")  # fmt: skip
def _(spark, d):
    nodes = trees.build_tree(_category_tree(spark, d), 2)
    return nodes.groupBy("level").agg(F.count_distinct("tree_code").alias("nodes"), F.sum_distinct("tree_code").alias("code_sum"))


@query("tree_edges", TREE + """, m AS (SELECT max(p_partkey) AS last FROM part)
SELECT p_partkey AS src_id, last + code + 1 AS dst_id, 1.0::DOUBLE AS weight FROM t, dp, m WHERE level < depth AND level > 0""")  # fmt: skip
def _(spark, d):
    return trees.tree_edges(trees.build_tree(_category_tree(spark, d), 2), 2)


@query("tree_attributes", TREE + """,
r AS (SELECT code, level, p_brand, p_retailprice FROM t JOIN part USING (p_partkey)),
b AS (SELECT code, p_brand, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, p_brand) AS i FROM r GROUP BY code, p_brand)
SELECT code AS tree_code, any_value(r.level) AS level, any_value(b.p_brand) AS p_brand, round(avg(p_retailprice) + 0.0000123, 4) AS p_retailprice FROM r JOIN b USING (code) WHERE i = 1 GROUP BY code""")  # fmt: skip
def _(spark, d):
    leaves = _category_tree(spark, d).join(table(spark, d, "part", F.col("p_partkey").alias("item_id"), "p_brand", "p_retailprice"), "item_id")
    return rounded(trees.build_tree(leaves, 2, ["p_brand"], ["p_retailprice"]).select("tree_code", "level", "p_brand", (F.col("p_retailprice") + 0.0000123).alias("p_retailprice")), 4)  # off the halves that means of cents fall on


@query("tree_samples", TREE + f""", b AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT DISTINCT code AS tree_code, level FROM t), pl AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY tree_code) - 1 AS place, count(*) OVER (PARTITION BY level) AS size FROM n),
rows AS (SELECT user_id, item_id, t.level, t.code AS tree_code FROM b JOIN t ON t.p_partkey = item_id WHERE t.code > 0),
own AS (SELECT r.user_id, r.item_id, r.level, pl.place, pl.size, least(CASE r.level WHEN 3 THEN 2 WHEN 6 THEN 4 WHEN 11 THEN 8 ELSE 0 END, pl.size - 1) AS n,
  floor({u("r.user_id::VARCHAR || '|' || r.item_id::VARCHAR || '|' || r.level::VARCHAR", 4)} * (pl.size - 1))::BIGINT AS start FROM rows r JOIN pl USING (level, tree_code)),
j AS (SELECT *, unnest(range(n)) AS j FROM own WHERE n > 0)
SELECT user_id, item_id, level, tree_code, 1 AS label FROM rows
UNION ALL SELECT j.user_id, j.item_id, j.level, pl.tree_code, 0 FROM j JOIN pl ON pl.level = j.level AND pl.place = (j.place + 1 + (j.start + j.j) % (j.size - 1)) % j.size""")  # fmt: skip
def _(spark, d):
    nodes = trees.build_tree(_category_tree(spark, d), 2).select("item_id", "tree_code", "level")
    return sampling.tree_samples(_bought(spark, d).distinct(), nodes, "user_id", "item_id", 2, {3: 2, 6: 4, 11: 8}, seed=4)


@query("tree_positive_levels", BOUGHT + """, dp AS (SELECT greatest(1, ceil(log2(count(*)) - 1e-9)::INT) AS depth FROM part)
SELECT level, count(*) AS n FROM b, (SELECT unnest(range(1, depth + 1))::INT AS level FROM dp) GROUP BY level""")  # fmt: skip
def _(spark, d):
    nodes = trees.build_tree(_category_tree(spark, d), 2).select("item_id", "tree_code", "level")
    rows = sampling.tree_samples(_bought(spark, d).distinct(), nodes, "user_id", "item_id", 2, {}, seed=4)
    return rows.groupBy("level").agg(F.count("*").alias("n"))


BEAM_SQL = TREE + """,
prices AS (SELECT t.level, t.code, avg(p_retailprice) AS price, any_value(t.p_partkey) AS item_id FROM t JOIN part USING (p_partkey) GROUP BY ALL),
q AS (SELECT s_suppkey AS query_id, 900.0 + abs(s_acctbal) / 20 AS wanted FROM supplier),
s AS (SELECT query_id, wanted, code, level, -abs(price - wanted) AS score, item_id FROM q, prices, dp WHERE level = least(depth, ceil(log2(20) - 1e-9))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -abs(price - wanted) DESC, code) <= 10),
r AS (SELECT * FROM s UNION ALL (SELECT r.query_id, r.wanted, p.code, p.level, -abs(p.price - r.wanted), p.item_id FROM r JOIN prices p ON p.level = r.level + 1 AND (p.code - 1) // 2 = r.code
  QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY -abs(p.price - r.wanted) DESC, p.code) <= 10))
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r, dp WHERE level = depth) WHERE rank <= 5"""  # fmt: skip


def _priced(spark, d) -> tuple[DataFrame, DataFrame]:
    """Wanted prices, and a tree whose nodes have their leaves' mean price."""
    leaves = _category_tree(spark, d).join(table(spark, d, "part", F.col("p_partkey").alias("item_id"), "p_retailprice"), "item_id")
    queries = table(spark, d, "supplier", F.col("s_suppkey").alias("query_id"), (F.lit(900.0) + F.abs(F.col("s_acctbal")) / 20).alias("wanted"))
    return queries, trees.build_tree(leaves, 2, [], ["p_retailprice"])


@query("beam_search", BEAM_SQL)
def _(spark, d):
    """Nearest prices by tree: the score of a node is closeness of its leaves' mean price."""
    queries, nodes = _priced(spark, d)
    found = trees.beam_search(queries, nodes, 5, 2, lambda t: -F.abs(t["p_retailprice"] - t["wanted"]))
    return rounded(found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank")))


@query("tree_retrieval", BEAM_SQL)
def _(spark, d):
    """The same search with a dense model of two layers that measures the distance, in Arrow batches."""
    queries, nodes = _priced(spark, d)
    weights = dense.load_weights(spark.createDataFrame([("far.0.weight", 0, [1.0, -1.0]), ("far.0.weight", 1, [-1.0, 1.0]), ("far.1.weight", 0, [-1.0, -1.0])], dense.WEIGHTS))
    steps = [{"op": "mlp", "name": "far", "in": ["p_retailprice", "wanted"], "out": "score", "last": "none"}]
    found = trees.beam_search(queries, nodes, 5, 2, lambda t: dense.score(t, steps, weights, ["score"], t.columns))
    return rounded(found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank")))


# --- deltas and configs --------------------------------------------------------------------


def _delta_rows(spark, d) -> DataFrame:
    return table(spark, d, "events", F.col("event_id").alias("global_step"), F.col("event_type").alias("feature_name"), F.col("user_id").alias("key_id"), F.array("value").alias("embedding"))


@query("delta_latest", """
SELECT event_type AS feature_name, user_id AS key_id, max(event_id) AS global_step, [max_by(value, event_id)] AS embedding FROM events WHERE event_id > 2000 AND event_id <= 8000 GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return deltas.latest(deltas.changed_between(_delta_rows(spark, d), 2000, 8000), ["feature_name", "key_id"])


@query("delta_merge", "SELECT event_type AS feature_name, user_id AS key_id, max(event_id) AS global_step, [max_by(value, event_id)] AS embedding FROM events GROUP BY ALL")
def _(spark, d):
    rows = _delta_rows(spark, d)
    keys = ["feature_name", "key_id"]
    return deltas.merged(deltas.latest(rows.where("global_step < 5000"), keys), rows.where("global_step >= 5000"), keys)


@query("delta_reconcile", """
WITH a AS (SELECT event_type, user_id, max_by(value, event_id) AS v FROM events GROUP BY ALL), b AS (SELECT event_type, user_id, max_by(value, event_id) AS v FROM events WHERE event_id < 6000 GROUP BY ALL)
SELECT a.event_type AS feature_name, a.user_id AS key_id, CASE WHEN b.v IS NULL THEN 'MISSING' WHEN abs(a.v - b.v) <= 1e-6 + 1e-5 * abs(b.v) THEN 'MATCH' ELSE 'DIFFERENT' END AS status
FROM a LEFT JOIN b USING (event_type, user_id)""")  # fmt: skip
def _(spark, d):
    rows, keys = _delta_rows(spark, d), ["feature_name", "key_id"]
    return deltas.reconcile(deltas.latest(rows, keys), deltas.latest(rows.where("global_step < 6000"), keys), keys)


@query("feature_selection", """
WITH i AS (SELECT p_type AS "group", p_brand AS feature, avg(p_size) / 60 AS dropout FROM part GROUP BY ALL)
SELECT "group", feature, round(dropout, 6) AS dropout, rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY dropout, feature) AS rank FROM i) WHERE rank <= 4""")  # fmt: skip
def _(spark, d):
    importance = table(spark, d, "part", F.col("p_type").alias("group"), F.col("p_brand").alias("feature"), "p_size").groupBy("group", "feature").agg((F.avg("p_size") / 60).alias("dropout"))
    return rounded(configs.select_features(importance, 4).withColumn("rank", F.col("rank").cast("long")))
