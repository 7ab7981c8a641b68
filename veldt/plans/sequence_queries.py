"""Queries that apply every kind of feature step by step to users' histories, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bucketize import Bucketizer
from ..operators.features import (
    BoolMaskFeature, ComboFeature, CombineFeature, CustomFeature, ExprFeature, Feature, IdFeature, KvDotProduct, LookupFeature, MatchFeature, OverlapFeature, RawFeature, SequenceGroup, TokenizeFeature, sequenced,
)
from .feature_queries import table
from .features import FeaturePlan

QUERIES: dict = {}
ORACLE_SQL: dict = {}
STEPS = 50

H = """
WITH h AS (SELECT user_id, event_id, event_type, value, event_id % 3 AS k, event_id % 7 AS m, 'u' || (user_id % 5)::VARCHAR AS who, (user_id % 5)::DOUBLE AS factor,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events QUALIFY r <= 50)
SELECT user_id, {0} AS steps FROM h GROUP BY user_id"""


def _history(spark, d) -> DataFrame:
    """Sequences of a user's events, the latest first, and a few values of the user."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("event_id")).alias("o"), "event_type", "value"))).alias("l"))
    steps = lambda f: F.array_join(F.transform("l", f), ";")
    rest = lambda s, n: (-s["o"] % n).cast("string")
    pair = lambda a, b: F.concat_ws("\x1d", a, b)
    odd = lambda s: -s["o"] % 2 == 1
    return g.select(
        "user_id", steps(lambda s: s["event_type"]).alias("types"), steps(lambda s: s["value"].cast("string")).alias("amounts"), steps(lambda s: pair(s["event_type"], F.concat(F.lit("t"), rest(s, 3)))).alias("tags"),
        steps(lambda s: pair(rest(s, 3), rest(s, 7))).alias("digits"), steps(lambda s: F.when(odd(s), pair(F.lit("true"), F.lit("false"))).otherwise(pair(F.lit("false"), F.lit("true")))).alias("masks"),
        steps(lambda s: F.concat(s["event_type"], F.lit(":"), s["value"].cast("string"), F.lit("|other"))).alias("pairs"),
        F.concat(F.lit("u"), F.col("user_id") % 5).alias("who"), (F.col("user_id") % 5).cast("double").alias("factor"),
    )


def query(name: str, sql: str, feature: Feature, result, **how):
    """Register a feature over the history; `result` maps a step's values to what SQL has of the step."""

    def run(spark, d) -> DataFrame:
        out = FeaturePlan([sequenced(feature, STEPS, **how)]).apply(_history(spark, d), ["user_id"])
        return out.select("user_id", result(F.col(feature.name)).alias("steps"))

    QUERIES[name], ORACLE_SQL[name] = run, H.format(sql)


def firsts(digits: int | None = None):
    return lambda c: F.transform(c, lambda v: v[0] if digits is None else F.round(v[0], digits))


def every(c: Column) -> Column:
    return F.flatten(c)


MAP, NESTED = "const:click:1\x1dview:2\x1dpurchase:5\x1dt1:10", "const:a^click:1,view:2|b^click:3,purchase:4"

query("sequence_ids", "list(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 ELSE 1 END::BIGINT ORDER BY r)",
      IdFeature("f", ["user:types"], buckets=Bucketizer(vocab_list=["click", "view", "purchase"])), firsts())
query("sequence_raw", "list(round((value - 100) / 50, 6) ORDER BY r)", RawFeature("f", ["user:amounts"], normalizer="zscore", arguments={"mean": 100, "std": 50}), firsts(6))
query("sequence_combo", "flatten(list([who || '_' || event_type, who || '_t' || k::VARCHAR] ORDER BY r))", ComboFeature("f", ["user:who", "item:tags"]), every)
query("sequence_combo_first", "list(who || '_' || event_type ORDER BY r)", ComboFeature("f", ["user:who", "item:tags"]), every, value_dim=1)
query("sequence_combine", "list((k + m)::DOUBLE ORDER BY r)", CombineFeature("f", ["user:digits"], combiner="sum"), firsts())
query("sequence_lookup", "list(coalesce(nullif(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 5 ELSE 0 END + CASE k WHEN 1 THEN 10 ELSE 0 END, 0), -1)::DOUBLE ORDER BY r)",
      LookupFeature("f", [MAP, "item:tags"], "-1", combiner="sum"), firsts())
query("sequence_match", "list(CASE event_type WHEN 'click' THEN 3.0 WHEN 'purchase' THEN 4.0 ELSE 0.0 END::DOUBLE ORDER BY r)", MatchFeature("f", [NESTED, "const:b", "item:types"]), firsts())
query("sequence_expr", "list(round(value * factor + 1, 6) ORDER BY r)", ExprFeature("f", ["item:amounts", "user:factor"], expression="amounts * factor + 1"), firsts(6))
query("sequence_overlap", "list(((event_type = 'click')::INT + (k = 1)::INT)::DOUBLE / 2 ORDER BY r)", OverlapFeature("f", ["item:tags", "const:click\x1dt1\x1dz"]), firsts())
query("sequence_tokenize", "flatten(list(CASE event_type WHEN 'click' THEN [1, 2] WHEN 'view' THEN [3] WHEN 'purchase' THEN [4, 5] ELSE [6] END::INT[] ORDER BY r))",
      TokenizeFeature("f", ["user:types"], vocabulary={"cl": 1, "ick": 2, "view": 3, "pur": 4, "chase": 5, "signup": 6, "error": 6, "login": 6, "logout": 6}), every)
query("sequence_kv_dot", "list(round(CASE event_type WHEN 'click' THEN 2 * value WHEN 'view' THEN 3 * value ELSE 0 END + 1, 6)::DOUBLE ORDER BY r)", KvDotProduct("f", ["const:click:2|view:3|other", "item:pairs"]), firsts(6))
query("sequence_bool_mask", "list(CASE WHEN event_id % 2 = 1 THEN event_type ELSE 't' || k::VARCHAR END ORDER BY r)", BoolMaskFeature("f", ["item:tags", "item:masks"]), every)
query("sequence_custom", "list(levenshtein(event_type, 'clock')::DOUBLE ORDER BY r)", CustomFeature("f", ["item:types", "const:clock"], operator="EditDistance"), firsts())


def _grouped(spark, d) -> DataFrame:
    h = _history(spark, d).withColumnsRenamed({"types": "clicks__types", "digits": "clicks__digits"})
    group = SequenceGroup("clicks", STEPS, [CombineFeature("total", ["user:digits"], combiner="mean"), ComboFeature("cross", ["user:who", "user:types"])], fields=["digits", "types"])
    out = FeaturePlan([group]).apply(h, ["user_id"])
    return out.select("user_id", firsts()(F.col("clicks__total")).alias("means"), every(F.col("clicks__cross")).alias("steps"))


QUERIES["sequence_group"] = _grouped
ORACLE_SQL["sequence_group"] = H.format("list((k + m)::DOUBLE / 2 ORDER BY r) AS means, list(who || '_' || event_type ORDER BY r)")
