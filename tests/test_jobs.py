"""Jobs over paths, from their arguments to the tables they write."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.__main__ import JOBS, main
from veldt.sources import io
from veldt.streaming import progress as P


def test_eval_and_predict(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, i / 10, int(i > 4), i % 2) for i in range(10)], "id long, x double, label int, g int").write.parquet(f"{d}/in.parquet")
    main(["predict", "--input", f"{d}/in.parquet", "--weights", '{"x": 4.0}', "--bias", "-2", "--reserved", "id,label,g", "--output", f"{d}/out.parquet"], spark)
    out = spark.read.parquet(f"{d}/out.parquet")
    assert out.columns == ["logits", "probs", "id", "label", "g"] and out.where("id = 5").first()["probs"] == 0.5
    main(["eval", "--input", f"{d}/out.parquet", "--output", f"{d}/report", "--group", "g", "--step", "7"], spark)
    line = json.loads(spark.read.text(f"{d}/report").first()[0])
    assert line["auc"] == 1.0 and line["grouped_auc"] == 1.0 and line["accuracy"] == 1.0 and line["global_step"] == 7


def test_hitrate(spark, tmp_path):
    d, rng = str(tmp_path), np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    spark.createDataFrame([(i, ",".join(map(str, x))) for i, x in enumerate(v)], "item_id long, item_tower_emb string").write.parquet(f"{d}/items.parquet")
    spark.createDataFrame([(i, f"{i},{i + 1}", ",".join(map(str, v[i]))) for i in range(5)], "request_id long, gt_items string, user_tower_emb string").write.parquet(f"{d}/queries.parquet")
    main(["hitrate", "--queries", f"{d}/queries.parquet", "--items", f"{d}/items.parquet", "--output", f"{d}/out", "--k", "3", "--metric", "l2"], spark)
    hits = sum(len({i, i + 1} & set(np.argsort(((v - v[i]) ** 2).sum(1))[:3].tolist())) for i in range(5))
    assert spark.read.parquet(f"{d}/out/total").first()["hitrate"] == pytest.approx(hits / 10)


def test_tree_and_ids(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, f"c{i % 3}", [float(i), 1.0], [i % 2, i % 3]) for i in range(12)], "item_id long, category string, v array<double>, codes array<int>").write.parquet(f"{d}/in.parquet")
    main(["init-tree", "--input", f"{d}/in.parquet", "--output", f"{d}/tree", "--attributes", "category"], spark)
    main(["init-tree", "--input", f"{d}/in.parquet", "--output", f"{d}/clusters", "--vector", "v"], spark)
    for name in ("tree", "clusters"):
        assert spark.read.parquet(f"{d}/{name}/leaves").select("tree_code").distinct().count() == 12
        assert spark.read.parquet(f"{d}/{name}/serving").where("is_leaf").count() == 12
    main(["resolve-collisions", "--input", f"{d}/in.parquet", "--sizes", "2,16", "--output", f"{d}/ids.parquet"], spark)
    main(["sid-quality", "--input", f"{d}/in.parquet", "--sizes", "2,16", "--output", f"{d}/quality.parquet"], spark)
    assert spark.read.parquet(f"{d}/ids.parquet").count() == 12 and spark.read.parquet(f"{d}/quality.parquet").count() > 5
    with pytest.raises(ValueError, match="overlaps"):
        main(["sid-quality", "--input", f"{d}/in.parquet", "--sizes", "2,16", "--output", f"{d}/in.parquet"], spark)


def test_tables(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([("f", i, [float(i)]) for i in range(4)], "feature_name string, key_id long, embedding array<double>")
    rows.write.parquet(f"{d}/a.parquet")
    rows.where("key_id < 3").withColumn("embedding", F.when(F.col("key_id") == 0, F.array(F.lit(9.0))).otherwise(F.col("embedding"))).write.parquet(f"{d}/b.parquet")
    main(["compare-deltas", "--local", f"{d}/a.parquet", "--remote", f"{d}/b.parquet", "--output", f"{d}/c.parquet"], spark)
    assert {r["status"]: r["n"] for r in spark.read.parquet(f"{d}/c.parquet").collect()} == {"MATCH": 2, "DIFFERENT": 1, "MISSING": 1}
    spark.createDataFrame([("g", f"f{i}", i / 10) for i in range(5)], "group string, feature string, dropout double").write.parquet(f"{d}/i.parquet")
    main(["select-features", "--input", f"{d}/i.parquet", "--output", f"{d}/s.parquet", "--top", "2"], spark)
    assert {r["feature"] for r in spark.read.parquet(f"{d}/s.parquet").collect()} == {"f0", "f1"}
    assert len(JOBS) == 12
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_registered_formats_and_epochs(spark, tmp_path):
    held = {}
    io.register_format("kept", lambda s, paths, schema: held[paths[0]], lambda df, path, mode: held.__setitem__(path, df))
    df = spark.createDataFrame([("a", 4), ("b", 9)], "source string, position long")
    io.write(df, "here", "kept")
    assert io.read(spark, "here", columns=["source"], kind="kept").count() == 2
    state = P.with_epochs(P.with_epochs(df, "source", 1), "source", 2)
    assert P.epochs_done(df, "source") == 0 and P.epochs_done(state, "source") == 2 and state.count() == 3


def test_tree_retrieval(spark, tmp_path):
    """A model of given weights over stored nodes: the nearest leaves, and their recall."""
    d = str(tmp_path)
    spark.createDataFrame([(i, i, float(i)) for i in range(16)], "item_id long, category int, x double").write.parquet(f"{d}/in.parquet")
    main(["init-tree", "--input", f"{d}/in.parquet", "--output", f"{d}/tree", "--raw-attributes", "x"], spark)
    spark.createDataFrame([(q, q + 0.2) for q in range(3, 12)], "request long, wanted double").write.parquet(f"{d}/queries.parquet")
    spark.createDataFrame([(q, i) for q in range(3, 12) for i in (q, q + 1)], "request long, item_id long").write.parquet(f"{d}/truth.parquet")
    spark.createDataFrame([("far.0.weight", 0, [1.0, -1.0]), ("far.0.weight", 1, [-1.0, 1.0]), ("far.1.weight", 0, [-1.0, -1.0])], "name string, i int, v array<double>").write.parquet(f"{d}/weights.parquet")
    model = json.dumps([{"op": "mlp", "name": "far", "in": ["x", "wanted"], "out": "score", "last": "none"}])
    main(["tree-retrieval", "--queries", f"{d}/queries.parquet", "--nodes", f"{d}/tree/nodes", "--weights", f"{d}/weights.parquet", "--model", model, "--output", f"{d}/out", "--query-id", "request", "--k", "2", "--truth", f"{d}/truth.parquet"], spark)
    found = {(r["request"], r["rank"]): r["item_id"] for r in spark.read.parquet(f"{d}/out/found").collect()}
    assert found == {(q, k): q + k - 1 for q in range(3, 12) for k in (1, 2)}
    assert spark.read.parquet(f"{d}/out/recall").first()["recall"] == 1.0
