"""Feature operators as pure Column builders.

A feature names its inputs with a side prefix (`user:age`, `item:id`,
`context:hour`, `const:1`, or `feature:other`) and builds one Column from a
resolver that maps an input to a Column and its Spark type.  DataFrames enter in
veldt.plans.features only, so Catalyst sees one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..functions.bucketize import Bucketizer, boundary_bucket
from ..functions.expressions import Value, compile_expression
from ..functions.values import MULTI, SEQUENCE, key_values, let, literal_pattern, numbers, or_default, present, sequence_steps, sequence_values, split_on, strings, weighted

SIDES = ("user", "item", "context", "const", "feature")
Resolver = Callable[[str], tuple[Column, str]]


def side_of(name: str) -> tuple[str, str]:
    side, _, rest = name.partition(":")
    if side not in SIDES or not rest:
        raise ValueError(f"an input is side:name with a side of {', '.join(SIDES)}; got {name!r}")
    return side, rest


@dataclass(frozen=True)
class Feature:
    """Common parts of all features: `stub` outputs feed other features only."""

    name: str
    inputs: list[str]
    default: str | None = None
    separator: str = MULTI
    buckets: Bucketizer = field(default_factory=Bucketizer)
    stub: bool = False
    mask_share: float = 0.0

    def column(self, resolve: Resolver) -> Column:
        raise NotImplementedError

    def bucketed(self, values: Column) -> Column:
        """Ids of array<string>, or the values themselves where nothing discretises."""
        b = replace(self.buckets, default_value=self.default or None)
        return F.transform(values, b.apply) if b.active else values

    def bucketed_numbers(self, values: Column) -> Column:
        """Ids of array<double>, nulls left out."""
        kept = F.filter(values, lambda x: x.isNotNull())
        return self.bucketed(kept if self.buckets.boundaries is not None else F.transform(kept, whole_text)) if self.buckets.active else kept

    def number_default(self) -> Column:
        return F.lit(float(self.default)) if self.default else F.lit(None).cast("double")


def whole_text(x: Column) -> Column:
    """A number as text, whole numbers without a fraction."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def combine(values: Column, how: str) -> Column:
    """One number of array<double>: sum, mean or avg, min, max, count, gap_min, gap_max; nulls are left out, nothing gives null.

    gap_min and gap_max are the least and the greatest difference of neighbours
    in value order.
    """
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    most = lambda x: F.greatest(F.size(x) - 1, F.lit(0))
    gaps = lambda x: let(F.sort_array(x), lambda o: F.zip_with(F.slice(o, F.lit(2), most(o)), F.slice(o, F.lit(1), most(o)), lambda a, b: a - b))
    mean = lambda x: total(x) / F.size(x)
    one = {
        "sum": total, "mean": mean, "avg": mean, "min": F.array_min, "max": F.array_max, "count": lambda x: F.size(x).cast("double"),
        "gap_min": lambda x: F.array_min(gaps(x)), "gap_max": lambda x: F.array_max(gaps(x)),
    }
    if how not in one:
        raise ValueError(f"unknown combiner {how!r}")
    return let(F.filter(values, lambda x: x.isNotNull()), lambda kept: F.when(F.size(kept) > 0, one[how](kept)))


@dataclass(frozen=True)
class IdFeature(Feature):
    """Multi-values as ids; `weighted` items are `id:weight`."""

    weighted: bool = False

    def column(self, resolve: Resolver) -> Column:
        c, kind = resolve(self.inputs[0])
        if self.weighted:
            b = replace(self.buckets, default_value=self.default or None)
            return F.transform(weighted(c, kind, self.separator), lambda s: F.struct(b.apply(s["id"]).alias("id"), s["weight"].alias("weight")))
        return self.bucketed(or_default(strings(c, kind, self.separator), self.default, self.separator))


@dataclass(frozen=True)
class RawFeature(Feature):
    """Numbers, normalised and perhaps cut into boundary buckets.

    normalizer: log10 (threshold, default), zscore (mean, std), minmax (min,
    max) or expression (text in x).
    """

    width: int = 1
    normalizer: str | None = None
    arguments: dict = field(default_factory=dict)

    def normalised(self, x: Column) -> Column:
        a = self.arguments
        if self.normalizer is None:
            return x
        if self.normalizer == "log10":
            return F.when(x > a.get("threshold", 1e-10), F.log10(x)).otherwise(F.lit(float(a.get("default", -10.0))))
        if self.normalizer == "zscore":
            return (x - a["mean"]) / a["std"]
        if self.normalizer == "minmax":
            return (x - a["min"]) / (a["max"] - a["min"])
        if self.normalizer == "expression":
            return compile_expression(a["text"], {"x": x}).column
        raise ValueError(f"unknown normalizer {self.normalizer!r}")

    def column(self, resolve: Resolver) -> Column:
        c, kind = resolve(self.inputs[0])
        raw = F.transform(numbers(strings(c, kind, self.separator)), self.normalised)
        # the default stands for the finished value, so it is not normalised
        fallback = F.array(*[F.lit(float(d)) for d in self.default.split(self.separator) * (self.width if self.separator not in self.default else 1)]) if self.default else F.array_repeat(F.lit(0.0), self.width)
        values = F.coalesce(raw, fallback)
        if self.width > 1:
            values = F.when(F.size(values) == self.width, values).otherwise(F.raise_error(F.concat(F.lit(f"{self.name}: expected {self.width} values, got "), F.size(values))))
        return self.bucketed(values) if self.buckets.active else values


def crossed(left: Column, right: Column) -> Column:
    """All pairs of two array<string>, joined by an underscore."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.concat_ws("_", x, y))))


@dataclass(frozen=True)
class ComboFeature(Feature):
    """All combinations of several inputs' values, joined by an underscore; an empty side gives nothing."""

    def column(self, resolve: Resolver) -> Column:
        sides = [F.coalesce(strings(*resolve(i), self.separator), F.array().cast("array<string>")) for i in self.inputs]
        out = sides[0]
        for side in sides[1:]:
            out = crossed(out, side)
        return self.bucketed(or_default(F.when(F.size(out) > 0, out), self.default, self.separator))


@dataclass(frozen=True)
class CombineFeature(Feature):
    """Multi-values mapped to numbers and combined to one."""

    combiner: str = "sum"
    value_map: dict[str, float] | None = None

    def column(self, resolve: Resolver) -> Column:
        c, kind = resolve(self.inputs[0])
        values = strings(c, kind, self.separator)
        if self.value_map is not None:
            table = F.create_map(*[F.lit(x) for k, v in self.value_map.items() for x in (k, float(v))])
            found = F.transform(values, lambda v: table[v])
        else:
            found = numbers(values)
        one = F.coalesce(combine(found, self.combiner), self.number_default())
        return self.bucketed_numbers(F.array(one))


@dataclass(frozen=True)
class LookupFeature(Feature):
    """Keys (second input) looked up in a key-value map (first input) and combined.

    Without a combiner every value found stays.  Vectors have `width` > 1 and
    are split on `value_separator`; `need_key` puts the key and an underscore
    before a value that is not combined.
    """

    combiner: str = ""
    width: int = 1
    value_separator: str = ","
    need_key: bool = False

    def column(self, resolve: Resolver) -> Column:
        table = key_values(*resolve(self.inputs[0]), self.separator)
        keys = strings(*resolve(self.inputs[1]), self.separator)
        # the map is made once for a row, not once for a key
        hits = let(table, lambda t: F.transform(keys, lambda k: F.when(k.isNotNull(), F.element_at(t, k))))
        if self.width > 1:
            vectors = F.filter(F.transform(hits, lambda v: numbers(F.split(v, literal_pattern(self.value_separator)))), lambda v: v.isNotNull())
            fallback = F.array_repeat(F.coalesce(self.number_default(), F.lit(0.0)), self.width)
            return F.coalesce(F.get(vectors, F.lit(0)), fallback)
        discrete = self.buckets.active and self.buckets.boundaries is None
        if not self.combiner or self.need_key or discrete:
            named = F.zip_with(keys, hits, lambda k, v: F.concat(k, F.lit("_"), v)) if self.need_key else hits
            values = let(F.filter(named, lambda v: v.isNotNull()), lambda found: or_default(F.when(F.size(found) > 0, found), self.default, self.separator))
            return self.bucketed(values) if discrete or self.need_key else self.bucketed_numbers(numbers(values))
        one = F.coalesce(combine(numbers(hits), self.combiner), self.number_default())
        return self.bucketed_numbers(F.array(one))


@dataclass(frozen=True)
class MatchFeature(Feature):
    """Two-level lookup in `pk^sk:v,sk:v|pk^...`; the key ALL matches every entry of its level."""

    def column(self, resolve: Resolver) -> Column:
        outer = split_on(resolve(self.inputs[0])[0], "|")
        entry = lambda pk, kv: let(F.split(kv, ":", 2), lambda x: F.struct(pk.alias("pk"), x[0].alias("sk"), F.get(x, F.lit(1)).alias("v")))
        entries = F.flatten(F.transform(outer, lambda part: let(F.split(part, r"\^", 2), lambda ps: F.transform(F.split(F.get(ps, F.lit(1)), ","), lambda kv: entry(ps[0], kv)))))

        def key(i: str) -> Column:
            side, name = side_of(i)
            return F.lit("ALL") if name == "ALL" else present(resolve(i)[0].cast("string"))

        pk, sk = key(self.inputs[1]), key(self.inputs[2])
        hits = F.filter(entries, lambda e: ((pk == "ALL") | (e["pk"] == pk)) & ((sk == "ALL") | (e["sk"] == sk)) & e["v"].isNotNull())
        values = let(F.transform(hits, lambda e: e["v"]), lambda found: or_default(F.when(F.size(found) > 0, found), self.default, self.separator))
        discrete = self.buckets.active and self.buckets.boundaries is None
        return self.bucketed(values) if discrete else self.bucketed_numbers(numbers(values))


@dataclass(frozen=True)
class ExprFeature(Feature):
    """An expression over inputs named by their last part; `vectors` names array inputs; `fill_missing` stands for nulls."""

    expression: str = ""
    vectors: list[str] = field(default_factory=list)
    fill_missing: float | None = None

    def column(self, resolve: Resolver) -> Column:
        variables = {}
        for i in self.inputs:
            c, kind = resolve(i)
            name = side_of(i)[1]
            if name in self.vectors:
                variables[name] = Value(numbers(strings(c, kind, self.separator)), True)
            else:
                x = c.try_cast("double") if not kind.startswith("array") else F.get(numbers(strings(c, kind, self.separator)), F.lit(0))
                variables[name] = Value(F.coalesce(x, F.lit(self.fill_missing)) if self.fill_missing is not None else x)
        out = compile_expression(self.expression, variables)
        values = out.column if out.vector else F.array(out.column)
        fallback = F.array(self.number_default()) if self.default else F.array().cast("array<double>")
        values = F.when(values.isNull() | F.exists(values, lambda x: x.isNull()), fallback).otherwise(values)
        return self.bucketed_numbers(values)


@dataclass(frozen=True)
class OverlapFeature(Feature):
    """How the terms of the query (first input) occur in the title (second input)."""

    method: str = "query_common_ratio"

    def column(self, resolve: Resolver) -> Column:
        query, title = (strings(*resolve(i), self.separator) for i in self.inputs)
        return self.bucketed_numbers(F.array(F.coalesce(text_functions.overlap(query, title, self.method), F.lit(0.0))))


@dataclass(frozen=True)
class TokenizeFeature(Feature):
    """Normalise a text and turn it into vocabulary ids.

    With a `tokenizer` (the path of a tokenizers JSON or a sentencepiece model)
    the ids are its own, from an Arrow function; else the vocabulary is matched
    greedily within the plan.  `as_sequence` makes each token a step, at most
    `length` of them.
    """

    vocabulary: dict[str, int] = field(default_factory=dict)
    options: list[str] = field(default_factory=list)
    max_length: int | None = None
    stop_chars: str = ""
    unknown: int = 0
    tokenizer: str | None = None
    as_sequence: bool = False
    length: int = 50

    def text(self, c: Column) -> Column:
        return text_functions.normalise(F.coalesce(present(c), F.lit(self.default or "")), self.options, max_length=self.max_length, stop_chars=self.stop_chars)

    def column(self, resolve: Resolver) -> Column:
        c = self.text(resolve(self.inputs[0])[0])
        ids = F.get(text_functions.token_ids(self.tokenizer)(F.array(c)), F.lit(0)) if self.tokenizer else text_functions.greedy_tokens(c, self.vocabulary, self.unknown)
        return F.transform(F.slice(ids, 1, self.length), lambda t: F.array(t)) if self.as_sequence else ids


@dataclass(frozen=True)
class KvDotProduct(Feature):
    """Sum of products over shared keys of two key-value lists; a bare key counts 1; nothing shared gives the default or 0."""

    kv_separator: str = "|"

    def column(self, resolve: Resolver) -> Column:
        def table(i: str) -> Column:
            c, kind = resolve(i)
            t = key_values(c, kind, self.kv_separator)
            return F.transform_values(t, lambda k, v: F.coalesce(v.try_cast("double"), F.lit(1.0)))

        def dot(a: Column, b: Column) -> Column:
            product = lambda total, k: total + F.element_at(a, k) * F.element_at(b, k)
            return let(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda shared: F.when(F.size(shared) > 0, F.aggregate(shared, F.lit(0.0), product)))

        one = let(table(self.inputs[0]), lambda a: let(table(self.inputs[1]), lambda b: dot(a, b)))
        return self.bucketed_numbers(F.array(F.coalesce(one, self.number_default(), F.lit(0.0))))


@dataclass(frozen=True)
class BoolMaskFeature(Feature):
    """The values (first input) whose mask (second input) is true."""

    def column(self, resolve: Resolver) -> Column:
        values, masks = (strings(*resolve(i), self.separator) for i in self.inputs)
        pairs = F.arrays_zip(values.alias("v"), masks.alias("m"))
        kept = F.transform(F.filter(pairs, lambda p: F.lower(p["m"]).isin("true", "1")), lambda p: p["v"])
        return self.bucketed(or_default(F.when(F.size(kept) > 0, kept), self.default, self.separator))


#: Named operators of CustomFeature: (columns, parameters) -> Column.
CUSTOM: dict[str, Callable[[list[Column], dict], Column]] = {
    "EditDistance": lambda c, p: F.array(text_functions.edit_distance(F.coalesce(c[0], F.lit("")), F.coalesce(c[1], F.lit("")), p.get("encoding", "utf-8")).cast("double")),
    "RegexReplace": lambda c, p: F.array(F.regexp_replace(c[0], p["pattern"], p["replacement"])),
    "SeqExpr": lambda c, p: sequence_expression(c, p),
}


def register(name: str, build: Callable[[list[Column], dict], Column]) -> None:
    """Add a named operator for CustomFeature; it may wrap a pandas UDF."""
    CUSTOM[name] = build


def sequence_expression(columns: list[Column], parameters: dict) -> Column:
    """A formula of scalars with each step of sequences; parameters: formula, names, sequences, separator."""
    names, sequences = parameters["names"], set(parameters["sequences"])
    variables = {}
    for name, c in zip(names, columns, strict=True):
        variables[name] = Value(numbers(split_on(c.cast("string"), parameters.get("separator", "|"))), True) if name in sequences else Value(c.try_cast("double"))
    return compile_expression(parameters["formula"].replace("spherical_distance", "haversine"), variables).column


@dataclass(frozen=True)
class CustomFeature(Feature):
    """A registered operator by name."""

    operator: str = ""
    parameters: dict = field(default_factory=dict)
    numeric: bool = True

    def column(self, resolve: Resolver) -> Column:
        out = CUSTOM[self.operator]([resolve(i)[0] for i in self.inputs], self.parameters)
        return self.bucketed_numbers(out) if self.numeric else self.bucketed(out)


@dataclass(frozen=True)
class SequenceFeature(Feature):
    """Steps of multi-values, cut to the first `length`; an empty sequence has the default once, "0" unless named."""

    length: int = 50
    steps: str = SEQUENCE
    numeric: bool = False

    def column(self, resolve: Resolver) -> Column:
        c, kind = resolve(self.inputs[0])
        found = F.slice(sequence_values(c, kind, self.separator, self.steps), 1, self.length)
        found = F.when(F.size(found) > 0, found).otherwise(F.array(F.array(F.lit(self.default or "0"))))
        if self.numeric:
            values = F.transform(found, lambda s: numbers(s))
            return F.transform(values, lambda s: F.transform(s, lambda x: boundary_bucket(x, self.buckets.boundaries))) if self.buckets.boundaries else values
        return F.transform(found, self.bucketed)


#: Features of one input, which is the sequence on every side but `feature`.
SINGLE_INPUT = (IdFeature, RawFeature, TokenizeFeature, CombineFeature)


@dataclass(frozen=True)
class SequencedFeature(Feature):
    """Any feature applied to each step of its sequences; inputs that are no sequences are the same for every step.

    Use `sequenced`.  The result is an array of what the feature gives for each
    of the first `length` steps, of which `value_dim` values stay if that is not
    0.  A sequence without a value has one empty step, and a step without a
    value has the default, "0" unless named.  Several sequences go side by side,
    as long as the first.
    """

    feature: Feature | None = None
    sequences: tuple[bool, ...] = ()
    length: int = 50
    steps: str = SEQUENCE
    value_dim: int = 0

    def column(self, resolve: Resolver) -> Column:
        inner = replace(self.feature, default=self.feature.default or "0")
        place = {name: (outer, on) for name, outer, on in zip(inner.inputs, self.inputs, self.sequences)}
        lists = {name: sequence_steps(*resolve(outer), self.steps) for name, (outer, on) in place.items() if on}
        first = F.slice(lists[next(iter(lists))][0], 1, self.length)
        cut = (lambda v: F.slice(v, 1, self.value_dim)) if self.value_dim else (lambda v: v)
        if isinstance(inner, TokenizeFeature) and inner.tokenizer:
            # a function of Python takes the texts of all steps at once
            return F.transform(text_functions.token_ids(inner.tokenizer)(F.transform(first, inner.text)), cut)

        def step(s: Column, i: Column) -> Column:
            def at(name: str) -> tuple[Column, str]:
                if name not in lists:
                    return resolve(place[name][0])
                return (s if name == next(iter(lists)) else F.get(lists[name][0], i)), lists[name][1]

            return cut(inner.column(at))

        return F.transform(first, step)


def sequenced(feature: Feature, length: int = 50, steps: str = SEQUENCE, fields: list[str] = (), group: str | None = None, value_dim: int = 0) -> SequencedFeature:
    """The feature over sequences, alone or as a member of a group.

    Which inputs are sequences: those in `fields`, if any are named; else the
    one input of a feature that has only one, unless it is another feature's
    result; else those on the item's side.  In a group, the feature and its
    sequences have the group's name and two underscores before theirs.
    """
    one = isinstance(feature, SINGLE_INPUT)
    on = tuple((side_of(i)[1] in fields) if fields else (side_of(i)[0] != "feature" if one else side_of(i)[0] == "item") for i in feature.inputs)
    if not any(on):
        raise ValueError(f"{feature.name} has no input that is a sequence")
    prefix = f"{group}__" if group else ""
    inputs = [f"{side_of(i)[0]}:{prefix}{side_of(i)[1]}" if s else i for i, s in zip(feature.inputs, on)]
    return SequencedFeature(prefix + feature.name, inputs, feature.default, feature.separator, feature.buckets, feature.stub, feature.mask_share, feature, on, length, steps, value_dim)


@dataclass(frozen=True)
class SequenceGroup:
    """Sub-sequences of one history; each becomes `name__sub` with the group's length and step separator.

    Members are sequences of their own, or features of any kind, which are
    applied step by step (`fields` names their sequences, see `sequenced`).
    """

    name: str
    length: int
    members: list[Feature]
    steps: str = SEQUENCE
    fields: list[str] = ()

    def features(self) -> list[Feature]:
        plain = lambda m: replace(m, name=f"{self.name}__{m.name}", length=self.length, steps=self.steps)
        return [plain(m) if isinstance(m, SequenceFeature) else sequenced(m, self.length, self.steps, self.fields, self.name) for m in self.members]

    def scalars(self) -> list[IdFeature]:
        """The members again as plain features with the same defaults."""
        return [IdFeature(m.name, m.inputs, m.default, m.separator, m.buckets) for m in self.members]
