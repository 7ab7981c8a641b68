import json

import pytest
from pyspark.sql import types as T

from veldt.operators import metrics, sampling, scoring


def test_predict_and_report(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0, "x"), (2, 1.0, 0.0, "y")], "id long, a double, b double, other string")
    out = scoring.predict(df, scoring.linear_model({"a": 1.0, "b": 0.5}, -1.0), ["a", "b"], {"probs": T.DoubleType(), "logits": T.DoubleType()}, ["id"])
    assert out.columns == ["id", "logits", "probs"]
    assert {r["id"]: r["probs"] for r in out.collect()} == {1: 0.5, 2: 0.5}
    line = json.loads(scoring.report_line(metrics.evaluate(out.selectExpr("probs", "1 AS y"), {"b": (metrics.accuracy, "probs", "y"), "a": (metrics.l2_loss, "probs", "y")}), 7))
    assert list(line) == ["global_step", "a", "b"] and line["b"] == 1.0 and line["a"] == pytest.approx(0.25)


def test_expand_tree_samples(spark):
    samples = spark.createDataFrame([(1, 5, 1, 2, 1), (1, 5, 1, 1, 0)], "u int, item int, level int, tree_code long, label int")
    users = spark.createDataFrame([(1, 30)], "u int, age int")
    nodes = spark.createDataFrame([(11, 1, 1, "p"), (12, 2, 1, "q")], "item_id int, tree_code long, level int, attr string")
    assert sorted((r["label"], r["age"], r["attr"]) for r in sampling.expand_tree_samples(samples, users, nodes, "u").collect()) == [(0, 30, "p"), (1, 30, "q")]


def test_batch_helpers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    negatives = spark.createDataFrame([(9, "z")], "i int, s string")
    assert {r["group"] for r in sampling.merge_negatives(df, negatives, ["i", "s"]).collect()} == {"base", "neg"}
    from pyspark.sql import functions as F

    row = df.limit(1).select(sampling.append_candidates(F.lit("1;2"), F.array(F.lit("3")), ";").alias("t"), sampling.append_candidates(F.array(F.lit(1)), F.array(F.lit(2))).alias("l")).first()
    assert row["t"] == "1;2;3" and row["l"] == [1, 2]
    assert sampling.expansion(10, 3) == 4
    easy = spark.createDataFrame([(1, 2, 1)], "u int, i int, rank int")
    assert sampling.negatives_with_hard(easy, easy).where("hard").count() == 1
    assert sampling.tree_children(spark.createDataFrame([(1,)], "tree_code long"), 2).count() == 2
    assert sorted(r["i"] for r in sampling.shuffled(df, "i", seed=1).collect()) == [1, 2]


def test_regrouped(spark):
    df = spark.createDataFrame([(1, 2, 0.2), (1, 1, 0.1), (2, 1, 0.9)], "r int, i int, p double")
    assert {r["r"]: r["p"] for r in scoring.regrouped(df, "r", "i", ["p"]).collect()} == {1: [0.1, 0.2], 2: [0.9]}
