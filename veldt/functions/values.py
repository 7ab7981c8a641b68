"""Null, empty and multi-value conventions that all feature operators share.

An empty string is null.  A value without a default gives an empty list; with
one, the default stands in.  Multi-values are joined by MULTI (raw data) or
ENCODED (already encoded data); sequence steps by SEQUENCE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTI = "\x1d"
ENCODED = "\x03"
SEQUENCE = ";"


def let(value: Column, body) -> Column:
    """body(x) with x bound to the value, which is then worked out once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def literal_pattern(separator: str) -> str:
    """A regular expression for exactly this separator."""
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def present(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.when(c != "", c)


def split_on(c: Column, separator: str) -> Column:
    """A string's parts; null and empty strings give null."""
    return F.split(present(c), literal_pattern(separator), -1)


def strings(c: Column, kind: str, separator: str = MULTI) -> Column:
    """Any accepted input as array<string>, null where there is no value.

    `kind` is the Spark type of the column: a string is split, a list is cast
    element by element, a map gives its keys and a number is a list of one.
    """
    if kind == "string":
        return split_on(c, separator)
    if kind.startswith("array<"):
        return F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("string")))
    if kind.startswith("map<"):
        return F.when(F.size(c) > 0, F.transform(F.map_keys(c), lambda x: x.cast("string")))
    return F.when(c.isNotNull(), F.array(c.cast("string")))


def or_default(values: Column, default: str | None, separator: str = MULTI) -> Column:
    """Values, or else the default's parts, or else an empty list."""
    fallback = F.array(*[F.lit(x) for x in default.split(separator)]) if default else F.array().cast("array<string>")
    return F.coalesce(values, fallback)


def numbers(values: Column, kind: str = "double") -> Column:
    """Elements cast to a number; what is no number becomes null, fractions are cut for whole numbers."""
    return F.transform(values, lambda x: x.try_cast("double").try_cast(kind))


def key_values(c: Column, kind: str, separator: str = MULTI, joiner: str = ":") -> Column:
    """A map<string,string> of `k:v` items; of repeated keys the last wins (needs veldt.sources.session.configure)."""
    if kind.startswith("map<"):
        return F.map_from_arrays(F.transform(F.map_keys(c), lambda k: k.cast("string")), F.transform(F.map_values(c), lambda v: v.cast("string")))
    if kind.startswith("array<"):
        items = c
    else:
        items = split_on(c, separator)
    pairs = F.transform(items, lambda x: F.split(x, literal_pattern(joiner), 2))
    return let(pairs, lambda ps: F.map_from_arrays(F.transform(ps, lambda p: p[0]), F.transform(ps, lambda p: F.get(p, F.lit(1)))))


def strict_key_values(c: Column, kind: str, separator: str = MULTI, joiner: str = ":") -> Column:
    """Like key_values, but an item without a joiner is an error that shows the whole value."""
    if kind.startswith("map<"):
        return key_values(c, kind, separator, joiner)
    items = c if kind.startswith("array<") else split_on(c, separator)
    shown = F.array_join(c, separator) if kind.startswith("array<") else c
    bad = F.exists(items, lambda x: ~F.contains(x, F.lit(joiner)))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"expected items key{joiner}value, got "), shown))).otherwise(key_values(c, kind, separator, joiner))


def weighted(c: Column, kind: str, separator: str = MULTI) -> Column:
    """array<struct<id:string,weight:double>>; an item without a weight weighs 1, a row without a value is empty."""
    item = lambda k, w: F.struct(k.alias("id"), F.coalesce(w.try_cast("double"), F.lit(1.0)).alias("weight"))
    if kind.startswith("map<"):
        out = F.transform(F.map_entries(c), lambda e: item(e["key"].cast("string"), e["value"]))
    else:
        out = F.transform(strings(c, kind, separator), lambda x: item(F.split(x, ":")[0], F.get(F.split(x, ":"), F.lit(1))))
    return F.coalesce(out, F.array().cast("array<struct<id:string,weight:double>>"))


def sequence_values(c: Column, kind: str, separator: str = ENCODED, steps: str = SEQUENCE) -> Column:
    """array<array<string>>: steps of multi-values."""
    if kind == "string":
        return F.coalesce(F.transform(split_on(c, steps), lambda s: F.split(s, literal_pattern(separator), -1)), F.array().cast("array<array<string>>"))
    if kind.startswith("array<array<"):
        return F.coalesce(F.transform(c, lambda s: F.transform(s, lambda x: x.cast("string"))), F.array().cast("array<array<string>>"))
    return F.coalesce(F.transform(strings(c, kind, separator), lambda x: F.array(x)), F.array().cast("array<array<string>>"))


def sequence_steps(c: Column, kind: str, steps: str = SEQUENCE) -> tuple[Column, str]:
    """A sequence as an array of its steps, and the type of a step; without a value it has one empty step."""
    if kind.startswith("array<"):
        inner = kind[len("array<") : -1]
        return F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(None).cast(inner))), inner
    return F.split(F.coalesce(c.cast("string"), F.lit("")), literal_pattern(steps), -1), "string"


def dense(c: Column, kind: str, width: int, default: str = "0", separator: str = MULTI) -> Column:
    """array<double> of exactly `width`; another width is an error."""
    out = numbers(or_default(strings(c, kind, separator), separator.join([default] * width) if separator not in default else default, separator))
    return F.when(F.size(out) == width, out).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} values, got "), F.size(out))))
