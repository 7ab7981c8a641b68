"""Types that tables may have, and the text form of schemas."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SCALARS = {"INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}
ALIASES = {"BIGINT": "INT64", "INT": "INT32"}
MAP_KEYS = ("STRING", "INT64", "INT32")


def accepted_types() -> dict[str, T.DataType]:
    """All 30 accepted types by name: scalars, lists, lists of lists, and maps."""
    lists = {f"ARRAY_{n}": T.ArrayType(t) for n, t in SCALARS.items()}
    nested = {f"ARRAY_ARRAY_{n}": T.ArrayType(T.ArrayType(t)) for n, t in SCALARS.items()}
    maps = {f"MAP_{k}_{n}": T.MapType(SCALARS[k], t) for k in MAP_KEYS for n, t in SCALARS.items()}
    return SCALARS | lists | nested | maps


def parse_type(text: str) -> T.DataType:
    """A type by name (INT64, ARRAY_STRING) or in angle brackets (ARRAY<BIGINT>, MAP<STRING,FLOAT>); case is free."""
    clean = re.sub(r"\s+", "", text).upper()
    if not clean:
        raise ValueError("empty type")
    clean = re.sub(r"[A-Z0-9]+", lambda m: ALIASES.get(m[0], m[0]), clean)
    name = re.sub(r"[<,]", "_", clean).replace(">", "")
    name = re.sub(r"(?<![A-Z0-9])(BIGINT|INT)(?![A-Z0-9])", lambda m: ALIASES[m[0]], name)
    found = accepted_types().get(name)
    if found is None:
        raise ValueError(f"unknown type {text!r}")
    return found


def parse_schema(text: str) -> T.StructType:
    """`name:type;name:type;` as a schema; a last `;` is allowed."""
    fields = []
    for part in text.strip().rstrip(";").split(";"):
        if ":" not in part:
            raise ValueError(f"no colon in {part!r}")
        name, kind = (x.strip() for x in part.split(":", 1))
        if not name:
            raise ValueError(f"empty name in {part!r}")
        if not kind:
            raise ValueError(f"empty type in {part!r}")
        fields.append(T.StructField(name, parse_type(kind)))
    return T.StructType(fields)


def nullable_everywhere(t: T.DataType) -> T.DataType:
    """The type with all parts nullable, so that types compare by shape alone."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable_everywhere(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(nullable_everywhere(t.keyType), nullable_everywhere(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable_everywhere(f.dataType)) for f in t])
    return t


def same_type(a: T.DataType, b: T.DataType) -> bool:
    return nullable_everywhere(a) == nullable_everywhere(b)


def check_columns(schema: T.StructType, only: list[str] | None = None) -> None:
    """Raise for a column of a type that is not accepted."""
    accepted = [nullable_everywhere(t) for t in accepted_types().values()]
    for f in schema:
        if (only is None or f.name in only) and nullable_everywhere(f.dataType) not in accepted:
            raise ValueError(f"column [{f.name}] with dtype {f.dataType.simpleString()} is not supported now")


def project_by_name(have: T.StructType, want: T.StructType) -> list[str]:
    """Names of `want` as found in `have`; a missing or changed column is an error, extra ones are left out."""
    kinds = {f.name: f.dataType for f in have}
    for f in want:
        if f.name not in kinds:
            raise ValueError(f"column [{f.name}] is missing")
        if not same_type(kinds[f.name], f.dataType):
            raise ValueError(f"column [{f.name}] changed from {f.dataType.simpleString()} to {kinds[f.name].simpleString()}")
    return [f.name for f in want]
