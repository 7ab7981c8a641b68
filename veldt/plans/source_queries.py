"""Queries that write tables in every format and read them back, and that run streams to their end, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import configs, trees
from ..sources import io
from ..sources.session import scratch, stored
from ..streaming import progress as P
from .feature_queries import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    path = scratch(spark) + ".csv"
    io.write(table(spark, d, "customer"), path, inputs=[d])
    return io.read(spark, path, schema="c_custkey:BIGINT;c_name:STRING;c_nationkey:INT;c_acctbal:DOUBLE;c_mktsegment:STRING", where="c_acctbal > 0")


@query("partitioned_write", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    path = scratch(spark) + ".parquet"
    io.write(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return io.read(spark, path, columns=["o_orderkey", "o_totalprice", "o_orderstatus"], where="o_orderstatus = 'F'")


@query("predictions_written", "SELECT p_partkey, p_retailprice / 2 AS half, p_retailprice * 2 AS twice FROM part")
def _(spark, d):
    path = scratch(spark)
    io.write_predictions(table(spark, d, "part", "p_partkey", (F.col("p_retailprice") * 2).alias("twice"), (F.col("p_retailprice") / 2).alias("half")), path, ["twice", "half"], ["p_partkey"])
    return io.read(spark, path, kind="parquet", strict_types=True)


@query("bundle_round_trip", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    path = scratch(spark)
    io.write_bundle(spark, {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}, path, "g1", {"rows": 30})
    tables, _ = io.read_bundle(spark, path, "g1")
    return tables["nation"].join(F.broadcast(tables["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("vocabulary_file", "SELECT p_brand AS token, row_number() OVER (ORDER BY p_brand) + 1 AS id FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, d):
    path = scratch(spark)
    table(spark, d, "part", "p_brand").distinct().orderBy("p_brand").coalesce(1).write.text(path)
    return io.read_vocabulary(spark, path, 2)


@query("graph_table", "SELECT s_suppkey AS id, (s_nationkey + 1)::FLOAT AS weight, s_name AS name, s_nationkey::BIGINT AS nation FROM supplier")
def _(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id:int64"), (F.col("s_nationkey") + 1.0).alias("weight:float"), F.concat_ws(":", "s_name", "s_nationkey").alias("attrs:string"))
    rows.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    nodes, attrs = io.read_graph_table(spark, path), F.col("attrs")
    return nodes.select("id", "weight", io.attribute(attrs, 0, "string").alias("name"), io.attribute(attrs, 1, "bigint").alias("nation"))


@query("arrow_messages", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(spark, d):
    """Messages of up to 100 rows with their columns in another order, decoded by name."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return io.decode_arrow(io.encode_arrow(orders, ["o_orderpriority", "o_orderkey", "o_custkey"], 100), "value", orders.schema)


@query("ordered_read", """
SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id""")  # fmt: skip
def _(spark, d):
    return io.in_order_of(table(spark, d, "events", "user_id", "event_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


# --- streams: the events arrive as files; a run ends when all have been read ------------------------------


def _events(spark, d) -> DataFrame:
    """A stream of files of the events."""
    path = scratch(spark)
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(3, "event_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _played(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream gives, from the Parquet that its batches write."""
    path = scratch(stream.sparkSession)
    sink = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    sink.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


@query("stream_windows", """
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    counts = _played(P.windowed_counts(_events(spark, d), "ts", "6 hours", "3650 days", "event_type"), "update")
    # an updated window is written again: its latest count is its largest
    return counts.groupBy("start", "event_type").agg(F.max("n").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_delta_dump", "SELECT user_id, max(event_id) AS global_step, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def _(spark, d):
    path = scratch(spark)
    stream = _events(spark, d).select("user_id", F.col("event_id").alias("global_step"), "value")
    P.delta_dump(stream, ["user_id"], path, f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.max("global_step").alias("global_step"), F.max_by("value", "global_step").alias("value"))


def _arriving(spark, d, *parts: str) -> DataFrame:
    """A stream whose micro-batches are the events of each condition, one after the other."""
    path = scratch(spark)
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_triggers", """
WITH b AS (SELECT user_id, event_id % 3 AS batch, max(epoch_us(ts)) / 1e6 AS now FROM events GROUP BY ALL),
p AS (SELECT *, max(now) OVER (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM b)
SELECT user_id, now AS event_time, coalesce(floor(now / 21600) > floor(previous / 21600), false) AS fired FROM p""")  # fmt: skip
def _(spark, d):
    stream = _arriving(spark, d, *[f"event_id % 3 = {i}" for i in range(3)])
    return _played(P.event_time_trigger(stream, "user_id", "ts", 21600), "append").select("user_id", "event_time", "fired")


@query("stream_windows_sliding", """
WITH w AS (SELECT unnest([time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours']) AS start, event_type FROM events)
SELECT start::TIMESTAMP AS start, event_type, count(*) AS n FROM w GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    counts = _played(P.windowed_counts(_events(spark, d), "ts", "6 hours", "3650 days", "event_type", slide="3 hours"), "update")
    return counts.groupBy("start", "event_type").agg(F.max("n").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_windows_session", """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '6 hours', true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL '6 hours')::TIMESTAMP AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, session""")  # fmt: skip
def _(spark, d):
    counts = _played(P.windowed_counts(_events(spark, d), "ts", "6 hours", "3650 days", "user_id", session=True), "complete")
    # each batch writes all sessions so far: the last one holds them whole
    last = counts.agg(F.max("batch")).first()[0]
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return counts.where(F.col("batch") == last).select(ntz("start"), ntz("end"), "user_id", "n")


@query("stream_late_rows", """
WITH e AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, ts < TIMESTAMP '2024-01-16' AS early FROM events),
m AS (SELECT max(ts) - INTERVAL '1 day' AS mark FROM e WHERE event_id % 2 = 0 AND NOT early)
SELECT start::TIMESTAMP AS start, event_type, count(*) AS n FROM e, m WHERE early OR event_id % 2 = 0 OR start + INTERVAL '6 hours' > mark GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """A batch's rows are late by the watermark of the batch before the last one: odd events of windows more than a day behind the even ones are dropped."""
    stream = _arriving(spark, d, "event_id % 2 = 0 and ts >= '2024-01-16'", "ts < '2024-01-16'", "event_id % 2 = 1 and ts >= '2024-01-16'")
    counts = _played(P.windowed_counts(stream, "ts", "6 hours", "1 day", "event_type"), "update")
    return counts.groupBy("start", "event_type").agg(F.max("n").alias("n")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- tree exports and feature tables ------------------------------------------------------------------------


def _clusters(spark, d) -> DataFrame:
    return trees.cluster_tree(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 2, limit=200)


@query("cluster_tree", """
WITH n AS (SELECT count(*) AS n FROM embeddings), dp AS (SELECT greatest(1, ceil(log2(n) - 1e-9)::INT) AS depth, n FROM n)
SELECT n AS items, n AS codes, depth AS level, 1::BIGINT AS most_in_a_leaf FROM dp""")  # fmt: skip
def _(spark, d):
    leaves = stored(_clusters(spark, d)).groupBy("tree_code", "level").agg(F.count("*").alias("c"))
    return leaves.groupBy("level").agg(F.sum("c").alias("items"), F.count("*").alias("codes"), F.max("c").alias("most_in_a_leaf"))


@query("features_without_dropped", "SELECT DISTINCT p_brand AS feature_name FROM part WHERE p_brand <> 'Brand#1'")
def _(spark, d):
    info = table(spark, d, "part", F.col("p_brand").alias("feature_name")).distinct().withColumn("message", F.when(F.col("feature_name") == "Brand#1", "DROP IT"))
    return configs.without_dropped(info).select("feature_name")
