import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldt.functions.expressions import Parser, Value, compile_expression
from veldt.plans.feature_queries import F


def value(spark, text, **variables):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(k) if not isinstance(v, list) else F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in variables.items()])
    named = {k: Value(F.col(k), True) if isinstance(v, list) else F.col(k) for k, v in variables.items()}
    return row.select(compile_expression(text, named).column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("10 - 4 - 3", 3), ("8 / 4 / 2", 1), ("1 < 2 == 1", 1), ("1 || 0 && 0", 1), ("6 & 3 | 8", 10), ("!3 + 1", 1),
    ("1 > 2 ? 10 : 2 > 1 ? 20 : 30", 20), ("round(2.5) + round(-2.5)", 0), ("rint(2.5)", 2), ("trunc(-2.7)", -2), ("roundp(3.14159, 2)", 3.14), ("mod(7, 3)", 1), ("_pi", math.pi), ("ln(_e)", 1),
    ("min(3, 1, 2) + max(3, 1, 2)", 4), ("sum(1, 2, 3) + avg(1, 3)", 8), ("sigmoid(0)", 0.5), ("1e2 + .5", 100.5), ("sphere_dist(0, 0, 90, 0)", 6371 * math.pi / 2), ("haversine(0, 0, 90, 0)", 6371 * math.pi / 2),
])
def test_scalars(spark, text, want):
    assert math.isclose(value(spark, text, z=0), want, rel_tol=1e-9, abs_tol=1e-12)


def test_division_by_zero_is_null(spark):
    assert value(spark, "x / 0", x=1) is None and value(spark, "mod(x, 0)", x=1) is None


@pytest.mark.parametrize("text,want", [
    ("a + b", [11, 22]), ("a * 2 + s", [7, 9]), ("a > 1 ? b : s", [5, 20]), ("dot(a, b)", 50), ("variance(a)", 0.25), ("pop_variance(a)", 0.5), ("reduce_prod(b)", 200), ("l2_norm(c)", [0.6, 0.8]),
    ("len(a) + squared_norm(a)", 7), ("corr(a, b)", 1), ("euclid_dist(a, b)", math.sqrt(81 + 324)), ("a * one", [7, 14]), ("dot(s, s)", 25), ("-a", [-1, -2]),
])
def test_vectors(spark, text, want):
    got = value(spark, text, a=[1, 2], b=[10, 20], c=[3, 4], s=5, one=[7])
    assert got == pytest.approx(want)


@pytest.mark.parametrize("text", ["1 +", "nope", "sin(1, 2)", "foo(1)", "(1", "1 2", "a $ b", "min()"])
def test_errors(text):
    with pytest.raises(ValueError):
        Parser(text, {}).whole()


NUMBERS = st.integers(1, 9).map(str)
TREES = st.recursive(NUMBERS, lambda inner: st.tuples(inner, st.sampled_from(["+", "-", "*"]), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8)


@settings(max_examples=25, deadline=None)
@given(text=TREES)
def test_arithmetic_matches_python(spark, text):
    assert value(spark, text, z=0) == pytest.approx(eval(text))  # noqa: S307  digits, + - * and parentheses only
