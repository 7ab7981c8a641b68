"""Golden inputs and outputs of the feature operators."""

import math

import pytest
from pyspark.sql import functions as F

from veldt.functions.bucketize import Bucketizer
from veldt.operators.features import (
    BoolMaskFeature, ComboFeature, CombineFeature, CustomFeature, ExprFeature, IdFeature, KvDotProduct, LookupFeature, MatchFeature, OverlapFeature, RawFeature,
    SequenceFeature, SequenceGroup, TokenizeFeature, sequenced,
)
from veldt.plans.features import FeaturePlan, debug_dump

M = "\x1d"


def build(spark, schema, rows, *features, **kw):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r.asDict(recursive=True) for r in FeaturePlan(list(features), **kw).apply(df).collect()]


def values(spark, schema, rows, feature):
    return [r[feature.name] for r in build(spark, schema, rows, feature)]


def near(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(math.isclose(p, q, abs_tol=1e-6) for p, q in zip(x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("default,want", [(None, [["1", "2"], [], [], ["3"]]), ("0", [["1", "2"], ["0"], ["0"], ["3"]])])
def test_id_encoded(spark, default, want):
    assert values(spark, "a string", [("1\x032",), ("",), (None,), ("3",)], IdFeature("f", ["user:a"], default, separator="\x03")) == want


def test_id_from_number(spark):
    assert values(spark, "a bigint", [(1,), (2,), (None,), (3,)], IdFeature("f", ["user:a"])) == [["1"], ["2"], [], ["3"]]


@pytest.mark.parametrize("schema,rows", [
    ("a string", [("123:0.5",), ("1391:0.3",), (None,), (f"12:0.9{M}123:0.21",), ("",)]),
    ("a array<string>", [(["123:0.5"],), (["1391:0.3"],), (None,), (["12:0.9", "123:0.21"],), ([],)]),
    ("a map<string,float>", [({"123": 0.5},), ({"1391": 0.3},), (None,), ({"12": 0.9, "123": 0.21},), ({},)]),
])
def test_id_weighted(spark, schema, rows):
    got = values(spark, schema, rows, IdFeature("f", ["user:a"], weighted=True))
    assert [[s["id"] for s in r] for r in got] == [["123"], ["1391"], [], ["12", "123"], []]
    assert near([[s["weight"] for s in r] for r in got], [[0.5], [0.3], [], [0.9, 0.21], []])


@pytest.mark.parametrize("buckets,default,want", [
    (Bucketizer(vocab_list=["abc", "efg"]), None, [[2, 3], [], [1]]),
    (Bucketizer(vocab_list=["abc", "efg"]), "xyz", [[2, 3], [0], [1]]),
    (Bucketizer(vocab_list=["abc", "efg"]), "abc", [[2, 3], [2], [1]]),
    (Bucketizer(vocab_dict={"abc": 2, "efg": 2}), "abc", [[0, 2], [0], [1]]),
    (Bucketizer(vocab_list=["abc", "efg"], default_id=9), None, [[0, 1], [], [9]]),
])
def test_vocabulary(spark, buckets, default, want):
    assert values(spark, "a string", [(f"abc{M}efg",), ("",), ("hij",)], IdFeature("f", ["user:a"], default, buckets=buckets)) == want


def test_num_buckets(spark):
    assert values(spark, "a string", [(f"0{M}1",), ("",), ("2",)], IdFeature("f", ["user:a"], "3", buckets=Bucketizer(num_buckets=4))) == [[0, 1], [3], [2]]


def test_raw(spark):
    log = RawFeature("f", ["user:a"], "0.01", normalizer="log10", arguments={"threshold": 0.05, "default": 0.01})
    assert near(values(spark, "a string", [("0.1",), ("",), ("10",)], log), [[-1], [0.01], [1]])
    z = RawFeature("f", ["user:a"], normalizer="zscore", arguments={"mean": 0.1, "std": 10})
    assert near(values(spark, "a double", [(0.2,), (0.1,), (0.3,)], z), [[0.01], [0], [0.02]])
    m = RawFeature("f", ["user:a"], "0.1", width=2, normalizer="minmax", arguments={"min": 0.1, "max": 0.6})
    assert near(values(spark, "a string", [(f"0.2{M}0.5",), ("",), (f"0.3{M}0.6",)], m), [[0.2, 0.8], [0.1, 0.1], [0.4, 1.0]])
    b = RawFeature("f", ["user:a"], "0.1", buckets=Bucketizer(boundaries=[0.05, 0.15, 0.25]))
    assert values(spark, "a double", [(0.2,), (0.1,), (0.3,), (None,)], b) == [[2], [1], [3], [1]]
    e = RawFeature("f", ["user:a"], normalizer="expression", arguments={"text": "x ^ 2 + 1"})
    assert near(values(spark, "a double", [(2.0,)], e), [[5]])


def test_combo(spark):
    f = ComboFeature("f", ["user:u", "item:i"], buckets=Bucketizer(vocab_list=["ua_ia", "ua_ib", "ub_ia"]))
    got = values(spark, "u string, i string", [(f"ua{M}ub", f"ia{M}ib"), ("", "ia"), ("uc", "ia")], f)
    assert got == [[2, 3, 4, 1], [], [1]]


@pytest.mark.parametrize("how,want", [("sum", [[3], [3], [0], [0]]), ("mean", [[1.5], [3], [0], [0]]), ("count", [[2], [1], [0], [0]]), ("min", [[1], [3], [0], [0]]), ("gap_max", [[1], [0], [0], [0]])])
def test_combine(spark, how, want):
    assert near(values(spark, "a string", [(f"1.0{M}2.0",), ("3.0",), ("",), (None,)], CombineFeature("f", ["user:a"], "0", combiner=how)), want)


@pytest.mark.parametrize("how,want", [("sum", [[3], [3], [0], [0]]), ("mean", [[1], [3], [0], [0]])])
def test_combine_value_map(spark, how, want):
    f = CombineFeature("f", ["user:a"], "0", combiner=how, value_map={"tag1": 1, "tag2": 2, "tag3": 3}, buckets=Bucketizer(num_buckets=10))
    assert values(spark, "a string", [(f"tag1{M}tag2",), ("tag3",), ("",), (None,)], f) == want


LOOKUP = [(f"ca:1{M}cb:2", k) for k in (f"ca{M}cb", "ca", f"ca{M}cd", "cd", "")] + [("", "ca"), ("", "")]


def test_lookup(spark):
    f = lambda **kw: LookupFeature("f", ["user:m", "item:k"], "0", **kw)
    assert near(values(spark, "m string, k string", LOOKUP, f(combiner="sum")), [[3], [1], [1], [0], [0], [0], [0]])
    assert near(values(spark, "m string, k string", LOOKUP, f(combiner="mean")), [[1.5], [1], [1], [0], [0], [0], [0]])
    b = Bucketizer(boundaries=[-0.5, 0.5, 1.5, 2.5])
    assert values(spark, "m string, k string", LOOKUP, f(combiner="sum", buckets=b)) == [[4], [2], [2], [1], [1], [1], [1]]
    assert values(spark, "m string, k string", LOOKUP, f(buckets=b)) == [[2, 3], [2], [2], [1], [1], [1], [1]]
    v = LookupFeature("f", ["user:m", "item:k"], "0", width=2)
    assert near(values(spark, "m string, k string", [("ca:1,2", "ca"), ("ca:1,2", "cx")], v), [[1, 2], [0, 0]])


def test_lookup_map_and_array(spark):
    f = LookupFeature("f", ["user:m", "item:k"], "0", combiner="sum")
    assert near(values(spark, "m map<string,float>, k array<string>", [({"ca": 1.0, "cb": 2.0}, ["ca", "cb"]), (None, ["ca"])], f), [[3], [0]])


def test_match(spark):
    table = "ca^ba:1,bb:2|cb^ba:3,bb:4"
    rows = [(table, "ca", "ba"), (table, "ca", ""), (table, "", ""), (table, "ca", "ba"), (table, None, None)]
    f = MatchFeature("f", ["user:m", "item:c", "item:b"], "0")
    assert near(values(spark, "m string, c string, b string", rows, f), [[1], [0], [0], [1], [0]])
    every = MatchFeature("f", ["user:m", "item:ALL", "item:b"], "0")
    assert near(values(spark, "m string, c string, b string", rows[:1], every), [[1, 3]])


def test_expr(spark):
    f = ExprFeature("f", ["user:a", "item:b"], "0.1", expression="a + b")
    assert near(values(spark, "a double, b string", [(0.2, "0.2"), (0.1, "0.2"), (0.3, "0.2"), (None, "0.2")], f), [[0.4], [0.3], [0.5], [0.1]])
    d = ExprFeature("f", ["user:a", "item:b"], expression="dot(a, b)", vectors=["a", "b"], buckets=Bucketizer(boundaries=[0.05, 0.10, 0.15]))
    assert values(spark, "a array<double>, b array<double>", [([0.2, 0.3], [0.2, 0.2]), ([0.2, 0.2], [0.2, 0.2])], d) == [[2], [1]]
    m = ExprFeature("f", ["user:a"], expression="a * 2", fill_missing=4.0)
    assert near(values(spark, "a double", [(None,)], m), [[8]])


@pytest.mark.parametrize("method,want", [("query_common_ratio", 0.5), ("title_common_ratio", 0.25), ("is_contain", 0), ("is_equal", 0), ("index_of", -1), ("proximity_min_cover", 0), ("proximity_min_dist", 5)])
def test_overlap(spark, method, want):
    got = values(spark, "q string, t string", [(f"abc{M}efg", f"abc{M}qwe{M}rty{M}uio"), ("", "abc"), ("abc", None)], OverlapFeature("f", ["user:q", "item:t"], method=method))
    assert near(got, [[want], [0], [0]])


def test_overlap_positions(spark):
    rows = [(f"b{M}c", f"a{M}b{M}c{M}d{M}c")]
    for method, want in [("is_contain", 1), ("index_of", 1), ("proximity_min_cover", 2), ("proximity_min_dist", 1), ("proximity_max_dist", 3), ("proximity_avg_dist", 2)]:
        assert near(values(spark, "q string, t string", rows, OverlapFeature("f", ["user:q", "item:t"], method=method)), [[want]]), method


def test_kv_dot(spark):
    rows = [("a:0.5|b:0.5", "a:0.5|b:0.5"), ("a|b|c", "a|b"), ("a|b", ""), (None, None)]
    assert near(values(spark, "a string, b string", rows, KvDotProduct("f", ["user:a", "item:b"], "0.1")), [[0.5], [2], [0.1], [0.1]])
    b = KvDotProduct("f", ["user:a", "item:b"], "", buckets=Bucketizer(boundaries=[0.05, 0.15, 1]))
    assert values(spark, "a map<string,double>, b map<string,double>", [({"a": 0.5}, {"a": 1.0}), ({"a": 1.0}, {"a": 2.0}), (None, {"a": 1.0}), ({"b": 1.0}, {"a": 1.0})], b) == [[2], [3], [0], [0]]


def test_bool_mask(spark):
    got = values(spark, "v string, m string", [(f"1{M}2{M}3{M}4", f"true{M}false{M}true{M}false"), (None, "true")], BoolMaskFeature("f", ["user:v", "user:m"]))
    assert got == [["1", "3"], []]


def test_edit_distance(spark):
    f = CustomFeature("f", ["user:a", "user:b"], operator="EditDistance")
    assert values(spark, "a string, b string", [("裙子", "连衣裙")], f) == [[3.0]]
    b = CustomFeature("f", ["user:a", "user:b"], operator="EditDistance", buckets=Bucketizer(boundaries=[0, 5, 10]))
    assert values(spark, "a string, b string", [("裙子", "连衣裙")], b) == [[1]]


def test_sequence_expression(spark):
    f = CustomFeature("f", ["user:t", "user:s"], operator="SeqExpr", parameters={"names": ["t", "s"], "sequences": ["s"], "formula": "t - s"})
    assert near(values(spark, "t string, s string", [("10", "2|3"), ("10", "4")], f), [[8, 7], [6]])


def test_sequences(spark):
    f = SequenceFeature("f", ["user:a"], separator="\x03")
    got = values(spark, "a string", [("1;2",), ("",), ("3",), ("4\x035;6",), (None,)], f)
    assert got == [[["1"], ["2"]], [["0"]], [["3"]], [["4", "5"], ["6"]], [["0"]]]
    group = SequenceGroup("clicks", 2, [SequenceFeature("id", ["user:a"], buckets=Bucketizer(num_buckets=9)), SequenceFeature("price", ["user:p"], numeric=True)])
    got = build(spark, "a string, p string", [("1;2;3", "0.5;1.5;2.5")], group)
    assert got == [{"clicks__id": [[1], [2]], "clicks__price": [[0.5], [1.5]]}]
    assert [s.name for s in group.scalars()] == ["id", "price"]


def test_sequenced_combo(spark):
    """A user's value with the steps of a sequence; an empty step has the default, or 0."""
    rows = [("ua", f"abc{M}efg;hij"), ("", ""), ("ub", "hij")]
    combo = lambda default, dim: sequenced(ComboFeature("c", ["user:id", "item:iid"], default), group="click", value_dim=dim)
    assert combo(None, 0).name == "click__c" and combo(None, 0).inputs == ["user:id", "item:click__iid"]
    schema = "id string, click__iid string"
    assert values(spark, schema, rows, combo(None, 0)) == [[["ua_abc", "ua_efg"], ["ua_hij"]], [["0"]], [["ub_hij"]]]
    assert values(spark, schema, rows, combo("xyz", 1)) == [[["ua_abc"], ["ua_hij"]], [["xyz"]], [["ub_hij"]]]


@pytest.mark.parametrize("how,bucketed,plain", [("sum", [[3], [1]], [[3], [1]]), ("mean", [[1], [1]], [[1.5], [1]])])
def test_sequenced_combine(spark, how, bucketed, plain):
    rows = [(f"tag1{M}tag2;tag1",), ("tag2",), ("",)]
    f = CombineFeature("f", ["user:a"], "0", combiner=how, value_map={"tag1": 1.0, "tag2": 2.0})
    assert values(spark, "a string", rows, sequenced(f)) == [plain, [[2]], [[0]]]
    f = CombineFeature("f", ["user:a"], None, combiner=how, value_map={"tag1": 1.0, "tag2": 2.0}, buckets=Bucketizer(num_buckets=10))
    assert values(spark, "a string", rows, sequenced(f)) == [bucketed, [[2]], [[0]]]


KEYS = [f"ca{M}cb;ca", "ca", f"ca{M}cd;ce", "cd", "", "ca", ""]
KV = [f"ca:1{M}cb:2"] * 5 + ["", ""]


@pytest.mark.parametrize("how,want", [("sum", [[[4], [2]], [[2]], [[2], [1]]]), ("mean", [[[3], [2]], [[2]], [[2], [1]]]), ("", [[[2, 3], [2]], [[2]], [[2], [1]]])])
def test_sequenced_lookup(spark, how, want):
    f = LookupFeature("f", ["user:kv", "item:k"], "0", combiner=how, buckets=Bucketizer(boundaries=[-0.5, 0.5, 1.5, 2.5]))
    got = values(spark, "kv string, k string", list(zip(KV, KEYS)), sequenced(f))
    assert got[:3] == want and got[3:] == [[[1]]] * 4


def test_sequenced_lookup_of_vectors(spark):
    rows = list(zip([f"ca:1,2{M}cb:3,4"] * 3 + ["", f"ca:1,2{M}cb:3,4"], ["ca;cb", "cd;ca", "", "ca", ""]))
    f = sequenced(LookupFeature("f", ["user:kv", "item:k"], "0", width=2))
    assert values(spark, "kv string, k string", rows, f) == [[[1, 2], [3, 4]], [[0, 0], [1, 2]], [[0, 0]], [[0, 0]], [[0, 0]]]


def test_sequenced_inputs(spark):
    """Named fields win; a single input is the sequence unless it is a feature; of several the item's are."""
    f = CustomFeature("f", ["user:a", "user:b"], operator="EditDistance")
    assert sequenced(f, fields=["a"]).sequences == (True, False) and sequenced(IdFeature("i", ["user:a"])).sequences == (True,)
    with pytest.raises(ValueError, match="no input"):
        sequenced(f)
    with pytest.raises(ValueError, match="no input"):
        sequenced(IdFeature("i", ["feature:a"]))
    assert values(spark, "a string, b string", [("cat;hat;", "hat"), (None, "x")], sequenced(f, fields=["a"])) == [[[1.0], [0.0], [3.0]], [[1.0]]]
    # lists go as they are, and a shorter second sequence ends early
    two = sequenced(BoolMaskFeature("f", ["item:v", "item:m"]), length=3)
    rows = [([["1", "2"], ["3"], ["4"], ["5"]], [["true", "false"], ["true"]]), (None, None)]
    assert values(spark, "v array<array<string>>, m array<array<string>>", rows, two) == [[["1"], ["3"], ["0"]], [["0"]]]


def test_tokenizers(spark):
    """Ids of stored tokenizers, as a list, as a sequence of tokens, and step by step, equal to the libraries'."""
    import sentencepiece
    from tokenizers import Tokenizer

    bpe, piece = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
    want = {bpe: lambda t: Tokenizer.from_file(bpe).encode(t, add_special_tokens=False).ids, piece: sentencepiece.SentencePieceProcessor(model_file=piece).encode}
    texts = ["Abc efg; hij", "", None, "x"]
    for path, encode in want.items():
        f = TokenizeFeature("f", ["user:a"], "xyz", tokenizer=path, options=["TEXT_UPPER2LOWER"])
        ids = [encode(t.lower()) if t else encode("xyz") for t in texts]
        assert values(spark, "a string", [(t,) for t in texts], f) == ids
        many = TokenizeFeature("f", ["user:a"], "xyz", tokenizer=path, options=["TEXT_UPPER2LOWER"], as_sequence=True, length=2)
        assert values(spark, "a string", [(t,) for t in texts], many) == [[[i] for i in own[:2]] for own in ids]
        steps = [[encode(x.lower()) if x else encode("xyz") for x in (t or "").split(";")] for t in texts]
        assert values(spark, "a string", [(t,) for t in texts], sequenced(f)) == steps


def test_key_value_error_shows_the_row(spark):
    from veldt.functions.values import strict_key_values

    df = spark.createDataFrame([(f"a:1{M}b",)], "s string")
    with pytest.raises(Exception, match=f"got a:1{M}b"):
        df.select(strict_key_values(F.col("s"), "string")).collect()
    ok = spark.createDataFrame([(f"a:1{M}b:2",), ("",), (None,)], "s string").select(strict_key_values(F.col("s"), "string").alias("m")).collect()
    assert [r["m"] for r in ok] == [{"a": "1", "b": "2"}, None, None]


def test_tokenize(spark):
    f = TokenizeFeature("f", ["user:a"], vocabulary={"ab": 1, "abc": 2, "d": 3}, options=["TEXT_UPPER2LOWER"], unknown=9)
    assert values(spark, "a string", [("ABC abd x",), ("",), (None,)], f) == [[2, 1, 3, 9], [], []]


def test_plan_dag_const_stub_and_errors(spark):
    a = IdFeature("a", ["user:x"], stub=True)
    b = IdFeature("b", ["feature:a"], buckets=Bucketizer(num_buckets=10))
    c = ComboFeature("c", ["feature:b", "const:k"])
    assert build(spark, "x string", [(f"1{M}2",)], c, b, a) == [{"c": ["1_k", "2_k"], "b": [1, 2]}]
    assert FeaturePlan([a, b, c]).source_columns() == ["x"]
    with pytest.raises(ValueError, match="circle"):
        build(spark, "x string", [("1",)], IdFeature("p", ["feature:q"]), IdFeature("q", ["feature:p"]))
    with pytest.raises(ValueError, match="mode dag"):
        build(spark, "x string", [("1",)], a, b, mode="normal")
    with pytest.raises(ValueError, match="repeated"):
        build(spark, "x string", [("1",)], a, a)


def test_bucketize_mode_and_dump(spark):
    df = spark.createDataFrame([(["abc", "x"],)], "f array<string>")
    plan = FeaturePlan([IdFeature("f", ["user:f"], buckets=Bucketizer(vocab_list=["abc"]))], mode="bucketize")
    out = plan.apply(df)
    assert out.first()["f"] == [2, 1]
    assert out.select(debug_dump(out, ["f"]).alias("d")).first()["d"] == "f:2,1"
    assert '"vocab_list"' in plan.to_json() and '"vocab_list"' not in plan.to_json(with_buckets=False)


def test_training_mask(spark):
    df = spark.range(2000).select(F.lit("1").alias("x"))
    n = FeaturePlan([IdFeature("f", ["user:x"], mask_share=0.5)]).apply(df, training=True).where(F.size("f") == 0).count()
    assert 800 < n < 1200


def test_vector_interactions_round_as_their_sql(spark, tmp_path):
    """Numbers that round to 0 keep the sign that the SQL's have."""
    import duckdb

    from veldt.plans import catalog

    tiny = 1e-4
    vectors = [[tiny, tiny, 0, 0, -tiny, -3e-7, 0, 0, tiny, 0, 0, 0], [tiny, 0, 0, 1, tiny, 0, 0, -2e-7, 0, tiny, 0, 0], [0.5, -0.25, 0, 0, 0.1, 0.7, 0, 0, -0.3, 0, 0, 1]]
    spark.createDataFrame([(i, v) for i, v in enumerate([[float(x) for x in v] for v in vectors])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = catalog.QUERIES["vector_interactions"](spark, str(tmp_path))
    want = {repr(tuple(r)) for r in con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL['vector_interactions']})").fetchall()}
    assert any("-0.0," in w for w in want)
    assert {repr(tuple(r)) for r in found.collect()} == want
