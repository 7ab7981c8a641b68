"""Queries that run the feature layer over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.bucketize import Bucketizer, admitted_ids, boundary_bucket, hash_bucket, vocabulary_join
from ..functions.expressions import Value, expression
from ..operators.features import (
    BoolMaskFeature, ComboFeature, CombineFeature, CustomFeature, ExprFeature, IdFeature, KvDotProduct, LookupFeature, MatchFeature, OverlapFeature, RawFeature,
    SequenceFeature, SequenceGroup, TokenizeFeature,
)
from ..sources.session import configure
from .features import FeaturePlan, debug_dump

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def one(c: str):
    """The single value of a feature's list."""
    return F.get(F.col(c), F.lit(0))


HASH = "(('0x' || substr(md5({0}), 1, 15))::BIGINT % {1})"


@query("id_hash_bucket", f"SELECT p_partkey, {HASH.format('p_brand', 1000)} AS brand_id, {HASH.format('p_partkey::VARCHAR', 97)} AS part_id FROM part")
def _(spark, d):
    plan = FeaturePlan([IdFeature("b", ["item:p_brand"], buckets=Bucketizer(hash_size=1000)), IdFeature("p", ["item:p_partkey"], buckets=Bucketizer(hash_size=97))])
    return plan.apply(table(spark, d, "part", "p_partkey", "p_brand"), ["p_partkey"]).select("p_partkey", one("b").alias("brand_id"), one("p").alias("part_id"))


@query("id_vocabulary", """
SELECT p_partkey,
  CASE p_type WHEN 'ECONOMY' THEN 2 WHEN 'SMALL' THEN 3 WHEN 'PROMO' THEN 4 ELSE 1 END::BIGINT AS list_id,
  CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 7 ELSE 1 END::BIGINT AS dict_id,
  CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 9 END::BIGINT AS default_id,
  CASE WHEN p_size < 40 THEN p_size ELSE 0 END::BIGINT AS size_id
FROM part""")  # fmt: skip
def _(spark, d):
    plan = FeaturePlan([
        IdFeature("l", ["item:p_type"], buckets=Bucketizer(vocab_list=["ECONOMY", "SMALL", "PROMO"])),
        IdFeature("m", ["item:p_type"], "ECONOMY", buckets=Bucketizer(vocab_dict={"ECONOMY": 5, "SMALL": 7})),
        IdFeature("o", ["item:p_type"], buckets=Bucketizer(vocab_list=["ECONOMY", "SMALL"], default_id=9)),
        IdFeature("s", ["item:p_size"], buckets=Bucketizer(num_buckets=40)),
    ])
    out = plan.apply(table(spark, d, "part", "p_partkey", "p_type", "p_size"), ["p_partkey"])
    return out.select("p_partkey", one("l").alias("list_id"), one("m").alias("dict_id"), one("o").alias("default_id"), one("s").alias("size_id"))


@query("vocabulary_join", """
WITH v AS (SELECT p_brand AS token, row_number() OVER (ORDER BY count(*) DESC, p_brand) + 1 AS id FROM part WHERE p_size <= 25 GROUP BY p_brand)
SELECT p_partkey, coalesce(v.id, 1)::BIGINT AS brand_id FROM part LEFT JOIN v ON p_brand = token""")  # fmt: skip
def _(spark, d):
    from pyspark.sql.window import Window

    part = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    counts = part.where("p_size <= 25").groupBy(F.col("p_brand").alias("token")).agg(F.count("*").alias("n"))
    words = counts.select("token", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).alias("id"))
    return vocabulary_join(part, "p_brand", words, "brand_id").select("p_partkey", "brand_id")


@query("managed_id_admission", """
WITH s AS (SELECT user_id AS id, count(*) AS cnt, max(event_id) AS last_step FROM events GROUP BY user_id),
m AS (SELECT max(event_id) AS now FROM events)
SELECT id, cnt, last_step, round(cnt / (now - last_step + 1.0)::DOUBLE, 9) AS score FROM s, m ORDER BY cnt / (now - last_step + 1.0)::DOUBLE DESC, id LIMIT 40""")  # fmt: skip
def _(spark, d):
    return admitted_ids(table(spark, d, "events", "user_id", "event_id"), "user_id", "event_id", 40, "distance_lfu").withColumn("score", F.round("score", 9))


@query("boundary_buckets", """
SELECT p_partkey, len(list_filter([950.0, 1000.0, 1200.5, 1800.0], lambda b: b <= p_retailprice))::BIGINT AS price_bucket FROM part""")  # fmt: skip
def _(spark, d):
    plan = FeaturePlan([RawFeature("b", ["item:p_retailprice"], buckets=Bucketizer(boundaries=[950, 1000, 1200.5, 1800]))])
    return plan.apply(table(spark, d, "part", "p_partkey", "p_retailprice"), ["p_partkey"]).select("p_partkey", one("b").alias("price_bucket"))


@query("raw_normalizers", """
SELECT l_orderkey, l_linenumber, l_partkey,
  round(CASE WHEN l_extendedprice > 1000 THEN log10(l_extendedprice) ELSE 2.5 END, 6) AS log_price,
  round((l_extendedprice - 38000) / 23000, 6) AS z_price,
  round((l_quantity - 1) / 49, 6) AS mm_quantity,
  round(sqrt(l_discount) + l_discount * 2, 6) AS e_discount
FROM lineitem""")  # fmt: skip
def _(spark, d):
    plan = FeaturePlan([
        RawFeature("a", ["item:l_extendedprice"], normalizer="log10", arguments={"threshold": 1000, "default": 2.5}),
        RawFeature("b", ["item:l_extendedprice"], normalizer="zscore", arguments={"mean": 38000, "std": 23000}),
        RawFeature("c", ["item:l_quantity"], normalizer="minmax", arguments={"min": 1, "max": 50}),
        RawFeature("e", ["item:l_discount"], normalizer="expression", arguments={"text": "sqrt(x) + x * 2"}),
    ])
    out = plan.apply(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"), ["l_orderkey", "l_linenumber", "l_partkey"])
    names = {"a": "log_price", "b": "z_price", "c": "mm_quantity", "e": "e_discount"}
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(one(k), 6).alias(v) for k, v in names.items()])


@query("combo_feature", """
SELECT c_custkey, n_name || '_' || c_mktsegment AS combo, (('0x' || substr(md5(n_name || '_' || c_mktsegment), 1, 15))::BIGINT % 500) AS combo_id
FROM customer JOIN nation ON c_nationkey = n_nationkey""")  # fmt: skip
def _(spark, d):
    # nation has 25 rows by definition of the schema
    df = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    plan = FeaturePlan([ComboFeature("c", ["user:n_name", "user:c_mktsegment"]), ComboFeature("h", ["user:n_name", "user:c_mktsegment"], buckets=Bucketizer(hash_size=500))])
    return plan.apply(df, ["c_custkey"]).select("c_custkey", one("c").alias("combo"), one("h").alias("combo_id"))


def _orders_text(spark, d) -> DataFrame:
    """Per customer: the priorities' first letters and prices of the orders as joined text."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("l"))
    return g.select(
        "o_custkey",
        F.array_join(F.transform("l", lambda s: F.substring(s["o_orderpriority"], 1, 1)), "\x1d").alias("digits"),
        F.array_join(F.transform("l", lambda s: s["o_orderstatus"]), "\x1d").alias("states"),
    )


@query("combine_feature", """
WITH g AS (SELECT o_custkey, list(substr(o_orderpriority, 1, 1)::DOUBLE) AS l, list(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.5 END::DOUBLE) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_sum(l) AS total, round(list_sum(l) / len(l), 6) AS mean, list_min(l) AS least, list_max(l) AS most, len(l)::DOUBLE AS n,
  coalesce(list_sum(s), 0.0) AS mapped, len(list_filter([2.0, 4.0, 8.0, 16.0], lambda b: b <= list_sum(l)))::BIGINT AS bucket,
  CASE WHEN len(l) > 1 THEN list_min(list_transform(range(1, len(l)), lambda i: list_sort(l)[i + 1] - list_sort(l)[i])) ELSE 0.0 END AS least_gap
FROM g""")  # fmt: skip
def _(spark, d):
    f = lambda name, how, **kw: CombineFeature(name, ["user:digits"], "0", combiner=how, **kw)
    plan = FeaturePlan([
        f("total", "sum"), f("mean", "mean"), f("least", "min"), f("most", "max"), f("n", "count"), f("least_gap", "gap_min"),
        CombineFeature("mapped", ["user:states"], "0", combiner="sum", value_map={"F": 1.0, "O": 2.5}),
        f("bucket", "sum", buckets=Bucketizer(boundaries=[2, 4, 8, 16])),
    ])
    out = plan.apply(_orders_text(spark, d), ["o_custkey"])
    return out.select("o_custkey", *[(F.round(one(c), 6) if c == "mean" else one(c)).alias(c) for c in out.columns[1:]])


def _brand_counts(spark, d) -> DataFrame:
    """Per customer: a text map brand -> quantity, and the brands of the latest order."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    sums = rows.groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    maps = sums.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "p_brand", "q"))), "\x1d").alias("kv"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    keys = rows.join(last, ["o_custkey", "o_orderkey"], "left_semi").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), "\x1d").alias("keys"))
    return maps.join(keys, "o_custkey", "left")


BRANDS = """
WITH r AS (SELECT o_custkey, o_orderkey, p_brand, p_type, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
s AS (SELECT o_custkey, p_brand, sum(l_quantity)::BIGINT AS q FROM r GROUP BY ALL),
lo AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey),
k AS (SELECT DISTINCT r.o_custkey, r.p_brand FROM r JOIN lo USING (o_custkey, o_orderkey))"""


@query("lookup_feature", BRANDS + """,
j AS (SELECT k.o_custkey, sum(q)::DOUBLE AS total, avg(q) AS mean, max(q)::DOUBLE AS most, count(*)::DOUBLE AS n FROM k JOIN s USING (o_custkey, p_brand) GROUP BY 1)
SELECT c.o_custkey, coalesce(total, -1.0) AS total, round(coalesce(mean, -1.0), 6) AS mean, coalesce(most, -1.0) AS most, coalesce(n, -1.0) AS n
FROM (SELECT DISTINCT o_custkey FROM s) c LEFT JOIN j USING (o_custkey)""")  # fmt: skip
def _(spark, d):
    f = lambda name, how: LookupFeature(name, ["user:kv", "item:keys"], "-1", combiner=how)
    out = FeaturePlan([f("total", "sum"), f("mean", "mean"), f("most", "max"), f("n", "count")]).apply(_brand_counts(spark, d), ["o_custkey"])
    return out.select("o_custkey", one("total").alias("total"), F.round(one("mean"), 6).alias("mean"), one("most").alias("most"), one("n").alias("n"))


@query("match_feature", """
WITH r AS (SELECT o_custkey, p_type, p_brand, count(*) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT DISTINCT o_custkey FROM r)
SELECT b.o_custkey,
  coalesce((SELECT q FROM r WHERE r.o_custkey = b.o_custkey AND p_type = 'PROMO' AND p_brand = 'Brand#7'), 0)::DOUBLE AS hit,
  coalesce((SELECT sum(q) FROM r WHERE r.o_custkey = b.o_custkey AND p_type = 'PROMO'), 0)::DOUBLE AS of_type
FROM b""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_type", "p_brand").agg(F.count("*").alias("q"))
    inner = rows.groupBy("o_custkey", "p_type").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "p_brand", "q"))), ",").alias("s"))
    nested = inner.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("^", "p_type", "s"))), "|").alias("kkv"))
    plan = FeaturePlan([MatchFeature("hit", ["user:kkv", "const:PROMO", "const:Brand#7"], "0"), MatchFeature("of_type", ["user:kkv", "const:PROMO", "const:ALL"], "0")])
    out = plan.apply(nested, ["o_custkey"])
    return out.select("o_custkey", one("hit").alias("hit"), F.aggregate("of_type", F.lit(0.0), lambda a, x: a + x).alias("of_type"))


@query("kv_dot_product", BRANDS + """,
a AS (SELECT o_custkey, p_brand, q FROM s WHERE p_brand < 'Brand#2'), b AS (SELECT o_custkey, p_brand, q FROM s WHERE p_brand > 'Brand#13')
SELECT c.o_custkey, coalesce((SELECT sum(a.q * b.q)::DOUBLE FROM a JOIN b USING (o_custkey, p_brand) WHERE a.o_custkey = c.o_custkey), 0.5) AS dot
FROM (SELECT DISTINCT o_custkey FROM s) c""")  # fmt: skip
def _(spark, d):
    items = F.split("kv", "\x1d")
    key = lambda x: F.split(x, ":")[0]
    df = _brand_counts(spark, d).select(
        "o_custkey", F.array_join(F.filter(items, lambda x: key(x) < "Brand#2"), "|").alias("a"), F.array_join(F.filter(items, lambda x: key(x) > "Brand#13"), "|").alias("b")
    )
    out = FeaturePlan([KvDotProduct("dot", ["user:a", "user:b"], "0.5")]).apply(df, ["o_custkey"])
    return out.select("o_custkey", one("dot").alias("dot"))


@query("overlap_feature", """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS q, string_split('red ' || p_name || ' ring ' || lower(p_type), ' ') AS t FROM part)
SELECT p_partkey,
  round(len(list_intersect(q, ['red', 'ring', 'small']))::DOUBLE / len(list_distinct(q)), 6) AS q_ratio,
  round(len(list_intersect(q, ['red', 'ring', 'small']))::DOUBLE / 3, 6) AS t_ratio,
  CASE WHEN list_contains(list_transform(range(1, greatest(len(t) - len(q) + 2, 1)), lambda i: t[i:i + len(q) - 1]), q) THEN 1.0 ELSE 0.0 END AS contained,
  coalesce(list_position(list_transform(range(1, greatest(len(t) - len(q) + 2, 1)), lambda i: t[i:i + len(q) - 1]), q), 0)::DOUBLE - 1 AS first_at,
  CASE WHEN q = t THEN 1.0 ELSE 0.0 END AS same
FROM t""")  # fmt: skip
def _(spark, d):
    df = table(spark, d, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", F.split("p_name", " ").alias("q"), F.array(F.lit("red"), F.lit("ring"), F.lit("small")).alias("w"),
        F.split(F.concat_ws(" ", F.lit("red"), "p_name", F.lit("ring"), F.lower("p_type")), " ").alias("t"),
    )
    f = lambda name, method, title: OverlapFeature(name, ["user:q", f"item:{title}"], method=method)
    out = FeaturePlan([f("q_ratio", "query_common_ratio", "w"), f("t_ratio", "title_common_ratio", "w"), f("contained", "is_contain", "t"), f("first_at", "index_of", "t"), f("same", "is_equal", "t")]).apply(df, ["p_partkey"])
    return out.select("p_partkey", *[F.round(one(c), 6).alias(c) for c in out.columns[1:]])


@query("overlap_proximity", """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS q, string_split('small ring ' || p_name || ' red widget', ' ') AS t FROM part),
p AS (SELECT p_partkey, len(t) AS n, len(list_distinct(q)) AS terms, unnest(range(1, len(t) + 1)) AS i, t, q FROM t),
h AS (SELECT p_partkey, n, terms, i, t[i] AS term FROM p WHERE list_contains(q, t[i])),
dd AS (SELECT a.p_partkey, min(b.i - a.i) AS lo, max(b.i - a.i) AS hi, avg(b.i - a.i) AS mean FROM h a JOIN h b ON a.p_partkey = b.p_partkey AND a.i < b.i AND a.term <> b.term GROUP BY 1),
w AS (SELECT a.p_partkey, a.i AS s, b.i AS e, count(DISTINCT c.term) AS terms FROM h a JOIN h b ON a.p_partkey = b.p_partkey AND a.i <= b.i JOIN h c ON c.p_partkey = a.p_partkey AND c.i BETWEEN a.i AND b.i GROUP BY 1, 2, 3),
cv AS (SELECT w.p_partkey, min(e - s + 1) AS cover FROM w JOIN (SELECT DISTINCT p_partkey, terms FROM p) x ON x.p_partkey = w.p_partkey AND x.terms = w.terms GROUP BY 1)
SELECT t.p_partkey, coalesce(cover, 0)::DOUBLE AS cover, coalesce(lo, len(t.t) + 1)::DOUBLE AS least, coalesce(hi, len(t.t) + 1)::DOUBLE AS most, round(coalesce(mean, len(t.t) + 1), 6)::DOUBLE AS mean
FROM t LEFT JOIN dd USING (p_partkey) LEFT JOIN cv USING (p_partkey)""")  # fmt: skip
def _(spark, d):
    df = table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.split("p_name", " ").alias("q"), F.split(F.concat_ws(" ", F.lit("small ring"), "p_name", F.lit("red widget")), " ").alias("t"))
    f = lambda name, method: OverlapFeature(name, ["user:q", "item:t"], method=method)
    out = FeaturePlan([f("cover", "proximity_min_cover"), f("least", "proximity_min_dist"), f("most", "proximity_max_dist"), f("mean", "proximity_avg_dist")]).apply(df, ["p_partkey"])
    return out.select("p_partkey", *[F.round(one(c), 6).alias(c) for c in out.columns[1:]])


SCALARS = {
    "sin(x) + cos(y)": "sin(x) + cos(y)", "tan(x) * atan(y)": "tan(x) * atan(y)", "asin(u) + acos(u)": "asin(u) + acos(u)",
    "sinh(u) + cosh(u) + tanh(u)": "sinh(u) + cosh(u) + tanh(u)", "asinh(x) + acosh(x + 1) + atanh(u / 2)": "asinh(x) + acosh(x + 1) + atanh(u / 2)",
    "log2(x) + log10(x) + log(x) + ln(x)": "log2(x) + log10(x) + 2 * ln(x)", "exp(-u) + sqrt(x)": "exp(-u) + sqrt(x)",
    "sign(y - 5) + abs(y - 5)": "sign(y - 5) + abs(y - 5)", "floor(x) + ceil(y) + trunc(-x)": "floor(x) + ceil(y) + trunc(-x)",
    "rint(x / 4) + round(y / 3)": "round_even(x / 4, 0) + floor(y / 3 + 0.5)", "roundp(x / 7, 2)": "floor(x / 7 * 100 + 0.5) / 100", "mod(x, 3) + sigmoid(u)": "x % 3 + 1 / (1 + exp(-u))",
    "min(x, y, 4) + max(x, y) + sum(x, y, 1) + avg(x, y)": "least(x, y, 4) + greatest(x, y) + x + y + 1 + (x + y) / 2",
    "x > y && x < 40 || u == 0": "CASE WHEN (x > y AND x < 40) OR u = 0 THEN 1.0 ELSE 0.0 END", "(x >= 10) + (y <= 5) + (x != y)": "(x >= 10)::INT + (y <= 5)::INT + (x <> y)::INT",
    "x & 12 | 3": "((x::BIGINT & 12) | 3)::DOUBLE", "2 ^ 3 ^ u - -x": "pow(2, pow(3, u)) + x", "x > 25 ? x / y : y * _pi + _e": "CASE WHEN x > 25 THEN x / y ELSE y * pi() + exp(1) END",
    "haversine(x, y, u, 3)": "2 * 6371.0 * asin(sqrt(pow(sin(radians(3 - y) / 2), 2) + cos(radians(y)) * cos(radians(3)) * pow(sin(radians(u - x) / 2), 2)))",
    "isnan(x) + 1 / (y - y + 2)": "0.5",
}


@query("expression_scalars", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({s}, 6)::DOUBLE AS e{i}" for i, s in enumerate(SCALARS.values())) + " FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_linenumber::DOUBLE AS y, l_discount AS u FROM lineitem)")
def _(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_discount").alias("u"))
    v = {k: F.col(k) for k in "xyu"}
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(expression(e, **v), 6).alias(f"e{i}") for i, e in enumerate(SCALARS)])


VECTORS = {
    "len(a)": "len(a)", "dot(a, b)": "list_dot_product(a, b)", "euclid_dist(a, b)": "list_distance(a, b)", "squared_norm(a)": "list_dot_product(a, a)",
    "corr(a, b)": "(n * list_dot_product(a, b) - list_sum(a) * list_sum(b)) / sqrt((n * list_dot_product(a, a) - list_sum(a) ** 2) * (n * list_dot_product(b, b) - list_sum(b) ** 2))",
    "variance(a)": "list_var_pop(a)", "pop_variance(a)": "list_var_samp(a)", "std_dev(a)": "list_stddev_pop(a)", "pop_std_dev(a)": "list_stddev_samp(a)",
    "reduce_min(a)": "list_min(a)", "reduce_max(a)": "list_max(a)", "reduce_sum(a)": "list_sum(a)", "reduce_mean(a)": "list_avg(a)",
    "reduce_prod(a * 3 + 1)": "list_product(list_transform(a, lambda x: x * 3 + 1))", "reduce_sum(l2_norm(a))": "list_sum(a) / sqrt(list_dot_product(a, a))",
    "reduce_sum(a * b + 1)": "list_dot_product(a, b) + n",
}


@query("expression_vectors", "SELECT vec_id, " + ", ".join(f"round({s}, 5)::DOUBLE AS e{i}" for i, s in enumerate(VECTORS.values())) + " FROM (SELECT vec_id, 16 AS n, embedding[1:16]::DOUBLE[] AS a, embedding[17:32]::DOUBLE[] AS b FROM embeddings)")
def _(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 16).alias("a"), F.slice(e, 17, 16).alias("b"))
    v = {k: Value(F.col(k), True) for k in "ab"}
    return df.select("vec_id", *[F.round(expression(x, **v), 5).alias(f"e{i}") for i, x in enumerate(VECTORS)])


@query("expr_feature", """
SELECT l_orderkey, l_linenumber, l_partkey, len(list_filter([1000.0, 20000.0, 50000.0], lambda b: b <= l_extendedprice * (1 - l_discount)))::BIGINT AS net_bucket FROM lineitem""")  # fmt: skip
def _(spark, d):
    plan = FeaturePlan([ExprFeature("n", ["item:l_extendedprice", "item:l_discount"], expression="l_extendedprice * (1 - l_discount)", buckets=Bucketizer(boundaries=[1000, 20000, 50000]))])
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return plan.apply(table(spark, d, "lineitem", *keys, "l_extendedprice", "l_discount"), keys).select(*keys, one("n").alias("net_bucket"))


@query("text_functions", r"""
SELECT doc_id, md5(upper(replace(text, 'ß', 'SS'))) AS upper_md5, md5(regexp_replace(text, '[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]', '', 'g')) AS filtered_md5, md5(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS packed_md5,
  md5(regexp_replace(text, '[aeiou]+', '_', 'g')) AS vowels_md5
FROM documents""")  # fmt: skip
def _(spark, d):
    md5 = lambda c: F.md5(c.cast("binary"))
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", md5(F.upper(t)).alias("upper_md5"), md5(text.normalise(t, ["TEXT_FILTER"])).alias("filtered_md5"), md5(text.normalise(t, ["TEXT_REMOVE_SPACE"])).alias("packed_md5"),
        md5(F.regexp_replace(t, "[aeiou]+", "_")).alias("vowels_md5"),
    )


@query("custom_features", """
SELECT p_partkey, levenshtein(p_name, 'small ring')::DOUBLE AS distance, len(list_filter([0.0, 5.0, 10.0], lambda b: b <= levenshtein(p_name, 'small ring')))::BIGINT AS distance_bucket,
  regexp_replace(p_brand, 'Brand#', 'B', 'g') AS short_brand
FROM part""")  # fmt: skip
def _(spark, d):
    f = lambda name, **kw: CustomFeature(name, ["item:p_name", "const:small ring"], operator="EditDistance", **kw)
    plan = FeaturePlan([f("a"), f("b", buckets=Bucketizer(boundaries=[0, 5, 10])), CustomFeature("c", ["item:p_brand"], operator="RegexReplace", parameters={"pattern": "Brand#", "replacement": "B"}, numeric=False)])
    out = plan.apply(table(spark, d, "part", "p_partkey", "p_name", "p_brand"), ["p_partkey"])
    return out.select("p_partkey", one("a").alias("distance"), one("b").alias("distance_bucket"), one("c").alias("short_brand"))


@query("tokenize_feature", """
WITH w AS (SELECT p_partkey, list_filter(string_split(upper(p_name), ' '), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, list_transform(l, lambda x: CASE x WHEN 'RED' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'RING' THEN 3 WHEN 'WIDGET' THEN 4 END)::INT[] AS ids
FROM w WHERE len(list_filter(l, lambda x: x NOT IN ('RED', 'SMALL', 'RING', 'WIDGET'))) = 0""")  # fmt: skip
def _(spark, d):
    df = table(spark, d, "part", "p_partkey", "p_name").where(F.upper("p_name").rlike("^((RED|SMALL|RING|WIDGET) ?)+$"))
    plan = FeaturePlan([TokenizeFeature("ids", ["item:p_name"], vocabulary={"RED": 1, "SMALL": 2, "RING": 3, "WIDGET": 4}, options=["TEXT_LOWER2UPPER"])])
    return plan.apply(df, ["p_partkey"])


def _history(spark, d) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("event_id")).alias("o"), "event_type", "value"))).alias("l"))
    return g.select("user_id", F.array_join(F.transform("l", lambda s: s["event_type"]), ";").alias("types"), F.array_join(F.transform("l", lambda s: s["value"].cast("string")), ";").alias("amounts"))


@query("sequence_features", """
WITH h AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT user_id, list(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 1 END::BIGINT ORDER BY r) AS type_ids, list(value ORDER BY r) AS amounts, count(*) AS n
FROM h WHERE r <= 50 GROUP BY user_id""")  # fmt: skip
def _(spark, d):
    group = SequenceGroup("h", 50, [
        SequenceFeature("type", ["user:types"], buckets=Bucketizer(vocab_list=["click", "view", "purchase"])),
        SequenceFeature("amount", ["user:amounts"], numeric=True),
    ])
    out = FeaturePlan([group]).apply(_history(spark, d), ["user_id"])
    return out.select("user_id", F.flatten("h__type").alias("type_ids"), F.flatten("h__amount").alias("amounts"), F.size("h__type").cast("long").alias("n"))


@query("bool_mask_feature", """
SELECT user_id, list(value ORDER BY event_id DESC) AS clicked FROM events WHERE event_type = 'click' GROUP BY user_id""")  # fmt: skip
def _(spark, d):
    df = _history(spark, d).select("user_id", F.transform(F.split("amounts", ";"), lambda x: x).alias("v"), F.transform(F.split("types", ";"), lambda t: (t == "click").cast("string")).alias("m"))
    out = FeaturePlan([BoolMaskFeature("b", ["user:v", "user:m"])]).apply(df, ["user_id"]).where(F.size("b") > 0)
    return out.select("user_id", F.transform("b", lambda x: x.cast("double")).alias("clicked"))


@query("sequence_expression", """
SELECT user_id, list(round(100 - value, 6) ORDER BY event_id DESC) AS below FROM events GROUP BY user_id""")  # fmt: skip
def _(spark, d):
    df = _history(spark, d).withColumn("top", F.lit("100"))
    f = CustomFeature("s", ["user:top", "user:amounts"], operator="SeqExpr", parameters={"names": ["t", "s"], "sequences": ["s"], "formula": "t - s", "separator": ";"})
    return FeaturePlan([f]).apply(df, ["user_id"]).select("user_id", F.transform("s", lambda x: F.round(x, 6)).alias("below"))


@query("weighted_ids", """
SELECT o_custkey, sum(q)::DOUBLE AS weight, count(*) AS n FROM (
  SELECT o_custkey, p_brand, sum(l_quantity)::BIGINT AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY o_custkey""")  # fmt: skip
def _(spark, d):
    out = FeaturePlan([IdFeature("w", ["user:kv"], weighted=True, buckets=Bucketizer(hash_size=100))]).apply(_brand_counts(spark, d), ["o_custkey"])
    return out.select("o_custkey", F.aggregate("w", F.lit(0.0), lambda a, s: a + s["weight"]).alias("weight"), F.size("w").cast("long").alias("n"))


@query("feature_dag", f"""
SELECT c_custkey, {HASH.format("(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)::VARCHAR || '_' || c_mktsegment || '_x'", 64)} AS f,
  'combo:' || (CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END)::VARCHAR || '_' || c_mktsegment || '_x' AS dump
FROM customer""")  # fmt: skip
def _(spark, d):
    plan = FeaturePlan([
        IdFeature("f", ["feature:combo"], buckets=Bucketizer(hash_size=64)),
        ComboFeature("combo", ["feature:rich", "user:c_mktsegment", "const:x"]),
        RawFeature("rich", ["user:c_acctbal"], buckets=Bucketizer(boundaries=[5000]), stub=True),
    ])
    out = plan.apply(table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment"), ["c_custkey"])
    return out.select("c_custkey", one("f").alias("f"), debug_dump(out, ["combo"]).alias("dump"))


@query("vector_interactions", """
WITH v AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS a, embedding[5:8]::DOUBLE[] AS b, embedding[9:12]::DOUBLE[] AS c FROM embeddings)
SELECT vec_id, round(a[1] * b[1] + a[1] * c[1] + b[1] * c[1], 6) AS fm_first, [round(list_dot_product(a, b), 6), round(list_dot_product(a, c), 6), round(list_dot_product(b, c), 6)] AS dots,
  round(list_cosine_similarity(a, b), 6) AS cosine, round((a[2] + b[2] + c[2]) / 3, 6) AS mean_second
FROM v""")  # fmt: skip
def _(spark, d):
    e = vectors.doubles(F.col("embedding"))
    df = table(spark, d, "embeddings").select("vec_id", F.array(*[F.slice(e, 1 + 4 * i, 4) for i in range(3)]).alias("f"))
    return df.select(
        "vec_id", vectors.rounded(vectors.fm_interaction(F.col("f"))[0], 6).alias("fm_first"), F.transform(vectors.pairwise_dots(F.col("f")), lambda x: vectors.rounded(x, 6)).alias("dots"),
        vectors.rounded(vectors.similarity(F.col("f")[0], F.col("f")[1]), 6).alias("cosine"), vectors.rounded(vectors.pool(F.col("f"))[1], 6).alias("mean_second"),
    )


@query("row_quantisation", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
SELECT vec_id, list_sum(list_transform(e, lambda x: round_even((x - lo) / ((hi - lo) / 255.0), 0)))::BIGINT AS code_sum,
  round(list_max(list_transform(e, lambda x: abs(round_even((x - lo) / ((hi - lo) / 255.0), 0) * ((hi - lo) / 255.0) + lo - x))), 6) AS worst
FROM v""")  # fmt: skip
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("e")).withColumn("q", vectors.quantise_row(F.col("e")))
    back = F.zip_with(vectors.dequantise_row(F.col("q")), "e", lambda a, b: F.abs(a - b))
    return df.select("vec_id", F.aggregate(F.col("q")["codes"], F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round(F.array_max(back), 6).alias("worst"))


@query("simple_attention", """
WITH v AS (SELECT vec_id, embedding[1:4]::DOUBLE[] AS q, [embedding[5:8]::DOUBLE[], embedding[9:12]::DOUBLE[], embedding[13:16]::DOUBLE[]] AS s FROM embeddings),
w AS (SELECT vec_id, s, list_transform(s, lambda x: exp(list_dot_product(q, x))) AS w FROM v)
SELECT vec_id, round((w[1] * s[1][1] + w[2] * s[2][1] + w[3] * s[3][1]) / list_sum(w), 6) AS first FROM w""")  # fmt: skip
def _(spark, d):
    e = vectors.doubles(F.col("embedding"))
    df = table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 4).alias("q"), F.array(*[F.slice(e, 5 + 4 * i, 4) for i in range(3)]).alias("s"))
    return df.select("vec_id", F.round(vectors.simple_attention(F.col("q"), F.col("s"))[0], 6).alias("first"))


@query("hash_and_boundary_columns", f"SELECT s_suppkey, {HASH.format('s_name', 31)} AS h, (s_acctbal >= 0)::INT + (s_acctbal >= 5000)::INT::BIGINT AS b FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", hash_bucket(F.col("s_name"), 31).alias("h"), boundary_bucket(F.col("s_acctbal"), [0, 5000]).alias("b"))
