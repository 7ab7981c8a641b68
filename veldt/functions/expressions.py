"""A small expression language compiled to Columns, so that Catalyst optimises it.

Scalars are doubles and vectors array<double>.  Operators work element by
element; a scalar, or a vector of one element, is spread over the other side.
Truth is 1.0 and 0.0.  Division and modulo by zero give null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
CONSTANTS = {"_pi": math.pi, "_e": math.e}
# binding powers, weakest first
PRECEDENCE = {"||": 1, "&&": 2, "|": 3, "&": 4, "<=": 5, ">=": 5, "!=": 5, "==": 5, ">": 5, "<": 5, "+": 6, "-": 6, "*": 7, "/": 7, "^": 8}
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9.]*)|(\|\||&&|<=|>=|!=|==|[-+*/^|&<>()?:,!]))")


@dataclass(frozen=True)
class Value:
    column: Column
    vector: bool = False


def _truth(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _whole(c: Column) -> Column:
    return c.cast("bigint")


def _haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a, b = F.sin(F.radians(y2 - y1) / 2), F.sin(F.radians(x2 - x1) / 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a * a + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * b * b))


def _sphere(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    cosine = F.sin(F.radians(y1)) * F.sin(F.radians(y2)) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.cos(F.radians(x2 - x1))
    return EARTH_RADIUS_KM * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _round(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _mean(v: Column) -> Column:
    return F.try_divide(_total(v), F.size(v).cast("double"))


def _spread(v: Column, less: int) -> Column:
    m = _mean(v)
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(v) - float(less))


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def _correlation(a: Column, b: Column) -> Column:
    n = F.size(a).cast("double")
    top = n * _dot(a, b) - _total(a) * _total(b)
    bottom = F.sqrt((n * _dot(a, a) - _total(a) * _total(a)) * (n * _dot(b, b) - _total(b) * _total(b)))
    return F.try_divide(top, bottom)


SCALAR: dict[str, tuple[int, Callable]] = {
    **{name: (1, getattr(F, name)) for name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "log2", "log10", "exp", "sqrt", "abs", "rint")},
    "log": (1, F.ln), "ln": (1, F.ln), "sign": (1, F.signum),
    "floor": (1, lambda x: F.floor(x).cast("double")), "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "trunc": (1, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")),
    "round": (1, _round), "roundp": (2, lambda x, p: _round(x * F.pow(F.lit(10.0), p)) / F.pow(F.lit(10.0), p)),
    "mod": (2, F.try_mod), "sigmoid": (1, lambda x: 1.0 / (1.0 + F.exp(-x))), "isnan": (1, lambda x: _truth(F.isnan(x))),
    "sphere_dist": (4, _sphere), "haversine": (4, _haversine),
}

VECTOR: dict[str, tuple[int, Callable, bool]] = {
    "len": (1, lambda v: F.size(v).cast("double"), False),
    "l2_norm": (1, lambda v: F.transform(v, lambda x: F.try_divide(x, F.sqrt(_dot(v, v)))), True),
    "squared_norm": (1, lambda v: _dot(v, v), False),
    "dot": (2, _dot, False),
    "euclid_dist": (2, lambda a, b: F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))), False),
    "corr": (2, _correlation, False),
    # as documented for this language, the plain names divide by n and the pop_ names by n - 1
    "variance": (1, lambda v: _spread(v, 0), False), "pop_variance": (1, lambda v: _spread(v, 1), False),
    "std_dev": (1, lambda v: F.sqrt(_spread(v, 0)), False), "pop_std_dev": (1, lambda v: F.sqrt(_spread(v, 1)), False),
    "reduce_min": (1, F.array_min, False), "reduce_max": (1, F.array_max, False),
    "reduce_sum": (1, _total, False), "reduce_mean": (1, _mean, False),
    "reduce_prod": (1, lambda v: F.aggregate(v, F.lit(1.0), lambda a, x: a * x), False),
}

VARIADIC: dict[str, Callable] = {
    "min": lambda *c: F.least(*c) if len(c) > 1 else c[0],
    "max": lambda *c: F.greatest(*c) if len(c) > 1 else c[0],
    "sum": lambda *c: sum(c[1:], c[0]),
    "avg": lambda *c: sum(c[1:], c[0]) / float(len(c)),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "||": lambda a, b: _truth((a != 0) | (b != 0)), "&&": lambda a, b: _truth((a != 0) & (b != 0)),
    "|": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"), "&": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"),
    "<=": lambda a, b: _truth(a <= b), ">=": lambda a, b: _truth(a >= b), "!=": lambda a, b: _truth(a != b), "==": lambda a, b: _truth(a == b),
    ">": lambda a, b: _truth(a > b), "<": lambda a, b: _truth(a < b),
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "^": F.pow,
}


def spread(f: Callable, values: list[Value]) -> Value:
    """Apply a scalar function element by element."""
    vectors = [v for v in values if v.vector]
    if not vectors:
        return Value(f(*[v.column for v in values]))
    if len(values) == 1:
        return Value(F.transform(values[0].column, f), True)
    longest = F.greatest(*[F.size(v.column) for v in vectors]) if len(vectors) > 1 else F.size(vectors[0].column)
    pick = lambda v, i: F.when(F.size(v.column) == 1, F.get(v.column, F.lit(0))).otherwise(F.get(v.column, i)) if v.vector else v.column
    index = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return Value(F.transform(index, lambda i: f(*[pick(v, i) for v in values])), True)


class Parser:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, text: str, variables: dict[str, Value], seed: int = 0):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at, self.variables, self.seed = 0, variables, seed

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        t = self.peek()
        if t is None or (wanted is not None and t != wanted):
            raise ValueError(f"expected {wanted or 'more'}, found {t!r}")
        self.at += 1
        return t

    def whole(self) -> Value:
        v = self.ternary()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()!r}")
        return v

    def ternary(self) -> Value:
        c = self.binary(1)
        if self.peek() != "?":
            return c
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        return spread(lambda c, y, n: F.when(c != 0, y).otherwise(n), [c, yes, no])

    def binary(self, least: int) -> Value:
        left = self.unary()
        while (op := self.peek()) in PRECEDENCE and PRECEDENCE[op] >= least:
            self.take()
            right = self.binary(PRECEDENCE[op] + (op != "^"))
            left = spread(BINARY[op], [left, right])
        return left

    def unary(self) -> Value:
        if self.peek() == "-":
            self.take()
            return spread(lambda x: -x, [self.binary(PRECEDENCE["^"])])
        if self.peek() == "!":
            self.take()
            return spread(lambda x: _truth(x == 0), [self.unary()])
        return self.atom()

    def atom(self) -> Value:
        t = self.take()
        if t == "(":
            v = self.ternary()
            self.take(")")
            return v
        if t[0].isdigit() or t[0] == ".":
            return Value(F.lit(float(t)))
        if self.peek() == "(":
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.ternary())
                if self.peek() == ",":
                    self.take(",")
            self.take(")")
            return self.call(t, args)
        if t in CONSTANTS:
            return Value(F.lit(CONSTANTS[t]))
        if t not in self.variables:
            raise ValueError(f"unknown name {t!r}")
        return self.variables[t]

    def call(self, name: str, args: list[Value]) -> Value:
        if name == "rnd":
            return Value(F.rand(self.seed))
        if name in VECTOR:
            n, f, vector = VECTOR[name]
            lists = [a.column if a.vector else F.array(a.column) for a in args]
        elif name in SCALAR:
            n, f = SCALAR[name]
        elif name in VARIADIC:
            if not args:
                raise ValueError(f"{name} needs arguments")
            return spread(VARIADIC[name], args)
        else:
            raise ValueError(f"unknown function {name!r}")
        if len(args) != n:
            raise ValueError(f"{name} takes {n} arguments, got {len(args)}")
        return Value(f(*lists), vector) if name in VECTOR else spread(f, args)


def compile_expression(text: str, variables: dict[str, Column | Value], seed: int = 0) -> Value:
    """The Column of an expression; variables are doubles unless given as Value(column, vector=True)."""
    named = {k: v if isinstance(v, Value) else Value(v.cast("double")) for k, v in variables.items()}
    return Parser(text, named, seed).whole()


def expression(text: str, **variables: Column | Value) -> Column:
    return compile_expression(text, variables).column
