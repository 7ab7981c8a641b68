import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.sources import io, schema
from veldt.streaming import progress as P


def test_types():
    assert len(schema.accepted_types()) == 30
    assert schema.parse_type(" bigint ") == T.LongType() and schema.parse_type("ARRAY<INT>") == T.ArrayType(T.IntegerType())
    assert schema.parse_type("map<string, float>") == T.MapType(T.StringType(), T.FloatType()) and schema.parse_type("ARRAY_ARRAY_DOUBLE") == T.ArrayType(T.ArrayType(T.DoubleType()))
    for bad in ("", "decimal", "map<double,int>"):
        with pytest.raises(ValueError):
            schema.parse_type(bad)


def test_schema_text():
    got = schema.parse_schema("a:INT64;b:array<string>;")
    assert got.names == ["a", "b"]
    for bad, message in (("a", "colon"), (":int", "name"), ("a:", "type"), ("a:foo", "unknown")):
        with pytest.raises(ValueError, match=message):
            schema.parse_schema(bad)
    loose = T.StructType([T.StructField("a", T.ArrayType(T.LongType(), False)), T.StructField("x", T.LongType())])
    want = T.StructType([T.StructField("a", T.ArrayType(T.LongType(), True))])
    assert schema.project_by_name(loose, want) == ["a"]
    with pytest.raises(ValueError, match="missing"):
        schema.project_by_name(want, loose)
    with pytest.raises(ValueError, match="not supported"):
        schema.check_columns(T.StructType([T.StructField("t", T.DateType())]))


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "k long, s string, x double")
    p, c = str(tmp_path / "t.parquet"), str(tmp_path / "t.csv")
    io.write(df, p)
    io.write(df, c)
    assert io.read(spark, p, ["x", "k"]).columns == ["k", "x"]
    assert io.read(spark, f"{p},{p}").count() == 4
    assert io.read(spark, c, schema="k:bigint;s:string;x:double").orderBy("k").collect() == df.orderBy("k").collect()
    plan = io.read(spark, p, ["k"], where="k > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,1)]" in plan and "ReadSchema: struct<k:bigint>" in plan
    with pytest.raises(ValueError, match="overlaps"):
        io.write(df, f"{p}/inner", inputs=[p])
    with pytest.raises(ValueError, match="not in"):
        io.read(spark, p, ["nope"])
    io.write_predictions(df.withColumn("b", F.lit(1)).withColumn("a", F.lit(2)), str(tmp_path / "out.parquet"), ["b", "a"], ["k"])
    assert spark.read.parquet(str(tmp_path / "out.parquet")).columns == ["a", "b", "k"]


def test_reading_in_order(spark):
    df = io.in_order_of(spark.range(100).selectExpr("99 - id AS d"), "d")
    assert [r["d"] for r in df.collect()] == list(range(100))


def test_text_tables(spark, tmp_path):
    (tmp_path / "list").write_text("abc\nefg\n")
    (tmp_path / "dict").write_text("abc 5\nefg 7\n")
    assert [tuple(r) for r in io.read_vocabulary(spark, str(tmp_path / "list"), 2).collect()] == [("abc", 2), ("efg", 3)]
    assert [tuple(r) for r in io.read_vocabulary(spark, str(tmp_path / "dict")).collect()] == [("abc", 5), ("efg", 7)]
    (tmp_path / "nodes").write_text("id:int64\tweight:float\tattrs:string\n1\t0.5\t1:我们:a\x1db\n2\t1.5\t2::\n")
    g = io.read_graph_table(spark, str(tmp_path / "nodes"))
    assert dict(g.dtypes) == {"id": "bigint", "weight": "float", "attrs": "string"}
    rows = g.orderBy("id").select(io.attribute(F.col("attrs"), 0, "bigint").alias("n"), io.attribute(F.col("attrs"), 1, "string").alias("s"), io.attribute(F.col("attrs"), 2, "array<string>").alias("l")).collect()
    assert [tuple(r) for r in rows] == [(1, "我们", ["a", "b"]), (2, None, None)]


def test_kafka_address():
    k = io.parse_kafka_uri("kafka://a:9092,b:9092/t?group.id=g&start.timestamp.ms=12")
    assert (k.brokers, k.topic, k.group, k.start_ms) == ("a:9092,b:9092", "t", "g", 12)
    assert io.kafka_options(k)["startingTimestamp"] == "12"
    assert io.kafka_options(k, {0: 4})["startingOffsets"] == '{"t": {"0": 5}}'
    given = io.parse_kafka_uri("kafka://a:1/t?group.id=g&auto.offset.reset=latest&security.protocol=SSL")
    assert io.kafka_options(given) == {"kafka.bootstrap.servers": "a:1", "subscribe": "t", "kafka.group.id": "g", "kafka.security.protocol": "SSL", "startingOffsets": "latest"}
    # partitions without a stored offset, added since perhaps
    assert io.kafka_options(k, {0: 4}, [0, 1, 2])["startingOffsets"] == '{"t": {"0": 5, "1": -2, "2": -2}}'
    assert io.kafka_options(given, {1: 7}, [0, 1])["startingOffsets"] == '{"t": {"0": -1, "1": 8}}'
    for bad in ("http://x", "kafka://a/t", "kafka://a/t?group.id=g&auto.offset.reset=never", "kafka://a/t?group.id=g&start.timestamp.ms=z"):
        with pytest.raises(ValueError):
            io.parse_kafka_uri(bad)


def test_arrow_messages(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    messages = io.encode_arrow(df, ["k", "s"]).unionByName(io.encode_arrow(df.coalesce(1), ["s", "k"], 1)).unionByName(spark.createDataFrame([(None,)], "value binary"))
    assert sorted(map(tuple, io.decode_arrow(messages, "value", schema.parse_schema("k:bigint")).collect())) == [(1,), (1,), (2,), (2,)]
    with pytest.raises(Exception, match="missing"):
        io.decode_arrow(messages, "value", schema.parse_schema("z:bigint")).collect()


def test_bundles(spark, tmp_path):
    io.write_bundle(spark, {"a": spark.range(3)}, str(tmp_path), "g1", {"n": 3})
    tables, info = io.read_bundle(spark, str(tmp_path), "g1")
    assert tables["a"].count() == 3 and info == {"n": 3}
    spark.range(2).write.parquet(str(tmp_path / "g2/a"))
    with pytest.raises(FileNotFoundError):
        io.read_bundle(spark, str(tmp_path), "g2")


# --- streams ---------------------------------------------------------------------------------


def test_quorum(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0, 4.0],), ([],), ([2.0, None],)], "t array<double>")
    assert [r[0] for r in df.select(P.quorum_time(F.col("t"), 0.75)).collect()] == [3.0, None, 2.0]


def test_triggers():
    assert not P.fires(None, 100, 10) and P.fires(9, 10, 10) and not P.fires(10, 19, 10) and P.fires(10, 19, 10, [15]) and not P.fires(5, -1, 10)
    assert P.decayed([1.0, 2.0], 0.9) == pytest.approx(1.1)


def test_streaming_operators(spark, tmp_path):
    """Files that arrive one by one: state goes on from batch to batch."""
    base = str(tmp_path)
    first = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 1.0)], "key string, global_step long, value double").withColumn("ts", F.timestamp_seconds(F.col("global_step") * 40))
    second = spark.createDataFrame([("a", 9, 1.0), ("b", 1, 3.0)], "key string, global_step long, value double").withColumn("ts", F.timestamp_seconds(F.col("global_step") * 40))
    first.coalesce(1).write.parquet(f"{base}/in")

    def stream():
        return spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def play(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q

    metric = P.decayed_metric(stream(), "key", "value", 0.5).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/m{n}")).outputMode("update").option("checkpointLocation", f"{base}/c1")
    fired = P.event_time_trigger(stream(), "key", "ts", 60).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/f{n}")).outputMode("append").option("checkpointLocation", f"{base}/c2")
    dump = P.delta_dump(stream(), ["key"], f"{base}/d", f"{base}/c3")
    for q in (metric, fired, dump):
        q.trigger(availableNow=True).start().awaitTermination(120)
    second.coalesce(1).write.mode("append").parquet(f"{base}/in")
    for q in (metric, fired, dump):
        q.trigger(availableNow=True).start().awaitTermination(120)
    assert {r["key"]: r["metric"] for r in spark.read.parquet(f"{base}/m0").collect()} == {"a": 6.0, "b": 1.0}
    assert {r["key"]: r["metric"] for r in spark.read.parquet(f"{base}/m1").collect()} == {"a": 3.5, "b": 2.0}
    assert {r["key"]: r["fired"] for r in spark.read.parquet(f"{base}/f0").collect()} == {"a": False, "b": False}
    assert {r["key"]: r["fired"] for r in spark.read.parquet(f"{base}/f1").collect()} == {"a": True, "b": False}
    assert {(r["batch"], r["key"]): r["value"] for r in spark.read.parquet(f"{base}/d").collect()} == {(0, "a"): 7.0, (0, "b"): 1.0, (1, "a"): 1.0, (1, "b"): 3.0}
    play(P.windowed_counts(stream(), "ts", "60 seconds", "10 minutes", "key"), "windows", "complete")
    assert sum(r["n"] for r in spark.table("windows").collect()) == 5
