"""Readers and writers: Parquet, CSV, catalog tables, Kafka, vocabulary and graph text files, and bundles."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import split_on
from .schema import check_columns, parse_schema, project_by_name


#: Formats beyond those of Spark: name -> (read(spark, paths, schema) or None, write(df, path, mode) or None).
FORMATS: dict[str, tuple] = {}


def register_format(name: str, reader=None, writer=None) -> None:
    """Add a format for `read` and `write`; a Python data source of Spark needs none, its name will do."""
    FORMATS[name] = (reader, writer)


def source_format(path: str, kind: str | None = None) -> str:
    """The format of a path by scheme or suffix, unless named."""
    if kind:
        return kind.lower()
    if path.startswith("kafka://"):
        return "kafka"
    if path.startswith("table://"):
        return "table"
    first = path.split(",")[0].rstrip("/*")
    for suffix in ("csv", "parquet", "orc", "json"):
        if first.endswith(f".{suffix}") or f".{suffix}/" in first:
            return suffix
    return "parquet"


def read(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | T.StructType | None = None, kind: str | None = None,
    delimiter: str = ",", header: bool = True, where: str | Column | None = None, strict_types: bool = False,
) -> DataFrame:
    """Read comma-joined paths or globs; columns and filters reach the scan.

    The first file gives the schema (mergeSchema is off) unless one is declared.
    Columns keep the file's order.  `strict_types` refuses types that the feature
    layer does not accept.
    """
    form, paths = source_format(path, kind), [p.strip() for p in path.split(",") if p.strip()]
    declared = parse_schema(schema) if isinstance(schema, str) else schema
    if form == "table":
        df = spark.table(path.removeprefix("table://").replace("/", "."))
    elif form == "kafka":
        raise ValueError("read streams with read_kafka")
    elif form in FORMATS and FORMATS[form][0] is not None:
        df = FORMATS[form][0](spark, paths, declared)
    else:
        r = spark.read
        if declared is not None:
            r = r.schema(declared)
        if form == "csv":
            r = r.option("sep", delimiter).option("header", header).option("inferSchema", declared is None)
        if form == "parquet":
            r = r.option("mergeSchema", False)
        df = r.format(form).load(paths)
    if where is not None:
        df = df.where(where)
    if columns is not None:
        missing = set(columns) - set(df.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are not in {path}")
        df = df.select(*[c for c in df.columns if c in set(columns)])
    if strict_types:
        check_columns(df.schema)
    return df


def in_order_of(df: DataFrame, *columns: str) -> DataFrame:
    """Ranges of the columns as partitions, each sorted, so that partitions are consumed in order (a date, say)."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def required_columns(features: list[str], labels: list[str] = (), weights: list[str] = (), extra: list[str] = ()) -> list[str]:
    """The columns that a job reads, each once, in order of need."""
    return list(dict.fromkeys([*features, *labels, *weights, *extra]))


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", partition_by: list[str] = (), inputs: list[str] = ()) -> None:
    """Write by the path's format; a target inside or around one of `inputs` is refused."""
    reject_overlap(path, list(inputs))
    form = source_format(path, kind)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if form in FORMATS and FORMATS[form][1] is not None:
        FORMATS[form][1](df, path, mode)
    elif form == "table":
        w.saveAsTable(path.removeprefix("table://").replace("/", "."))
    elif form == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(form).save(path)


def write_predictions(df: DataFrame, path: str, outputs: list[str], reserved: list[str], kind: str | None = None, mode: str = "errorifexists") -> None:
    """Model outputs in sorted order, then the reserved columns."""
    write(df.select(*sorted(outputs), *[c for c in reserved if c not in outputs]), path, kind, mode)


def reject_overlap(output: str, inputs: list[str]) -> None:
    """An output must not be an input, lie in one, or hold one."""
    clean = lambda p: re.sub(r"^file:/+", "/", p).rstrip("/*") + "/"
    for p in inputs:
        for one in p.split(","):
            a, b = clean(output), clean(one.strip())
            if a.startswith(b) or b.startswith(a):
                raise ValueError(f"output {output} overlaps input {one}")


# --- text tables --------------------------------------------------------------------


def read_vocabulary(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(token, id) of a file with `token` or `token id` on each line; without an id the line number counts from `start`."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    parts = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.trim("text") != "").select("line", parts[0].alias("token"), F.get(parts, F.lit(1)).try_cast("bigint").alias("given"))
    return rows.select("token", F.coalesce("given", F.col("line") + start).cast("bigint").alias("id"))


GRAPH_TYPES = {"int64": "bigint", "int32": "int", "float": "float", "double": "double", "string": "string"}


def read_graph_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose header names its types: id:int64, weight:float, attrs:string."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    fields = [h.split(":") for h in first["value"].split("\t")]
    schema = ", ".join(f"`{name}` {GRAPH_TYPES[kind]}" for name, kind in fields)
    raw = ", ".join(f"`{name}` string" for name, _ in fields)
    df = spark.read.schema(raw).option("sep", "\t").option("header", True).csv(path)
    kinds = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else None
    return df.select(*[F.col(f"`{n}`").try_cast(GRAPH_TYPES[k]).alias(n) for n, k in fields]) if kinds is None else df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])


def attribute(attrs: Column, index: int, kind: str, separator: str = ":", multi: str = "\x1d") -> Column:
    """One attribute of a graph node's joined attributes: a number, string, list or map; an empty one is null."""
    value = F.get(split_on(attrs, separator), F.lit(index))
    value = F.when(value != "", value)
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.transform(split_on(value, multi), lambda x: x.try_cast(inner))
    if kind.startswith("map<"):
        key, val = kind[4:-1].split(",")
        pairs = F.transform(split_on(value, multi), lambda x: F.split(x, "=", 2))
        return F.map_from_arrays(F.transform(pairs, lambda p: p[0].try_cast(key)), F.transform(pairs, lambda p: F.get(p, F.lit(1)).try_cast(val)))
    return value.try_cast(kind)


# --- streams ------------------------------------------------------------------------


@dataclass(frozen=True)
class KafkaSource:
    brokers: str
    topic: str
    group: str
    start_ms: int | None = None
    #: Consumer settings as Kafka names them, but for those that are set by other means.
    consumer: tuple[tuple[str, str], ...] = ()


#: Where a topic is read from that no offset is stored for, by Kafka's name for it.
RESETS = {"earliest": "earliest", "smallest": "earliest", "beginning": "earliest", "latest": "latest", "largest": "latest", "end": "latest"}


def parse_kafka_uri(uri: str) -> KafkaSource:
    """kafka://broker[,broker]/topic?group.id=g&start.timestamp.ms=t&...; other options are consumer settings."""
    m = re.fullmatch(r"kafka://([^/?]+)/([^/?]+)(?:\?(.*))?", uri)
    if not m:
        raise ValueError(f"not a Kafka address: {uri!r}")
    options = dict(parse_qsl(m[3] or "", keep_blank_values=True))
    group, start = options.pop("group.id", None), options.pop("start.timestamp.ms", None)
    if not group:
        raise ValueError("group.id is required")
    if start is not None and not re.fullmatch(r"\d+", start):
        raise ValueError(f"start.timestamp.ms must be a whole number, got {start!r}")
    reset = options.get("auto.offset.reset", "earliest")
    if reset not in RESETS:
        raise ValueError(f"auto.offset.reset must be one of {sorted(RESETS)}, got {reset!r}")
    return KafkaSource(m[1], m[2], group, int(start) if start else None, tuple(sorted(options.items())))


def kafka_options(source: KafkaSource, resume: dict[int, int] | None = None, partitions: list[int] | None = None) -> dict[str, str]:
    """Reader options: stored offsets plus one, else the start time, else what auto.offset.reset says, else the earliest.

    Spark wants an offset for every partition when it gets one for any: those of
    `partitions` that nothing is stored for begin at the earliest (-2) or, by
    auto.offset.reset, at the latest (-1).  Stored offsets go before the start time.
    """
    settings = dict(source.consumer)
    reset = RESETS[settings.pop("auto.offset.reset", "earliest")]
    out = {"kafka.bootstrap.servers": source.brokers, "subscribe": source.topic, "kafka.group.id": source.group} | {f"kafka.{k}": v for k, v in settings.items()}
    if resume:
        fresh = {p: -2 if reset == "earliest" else -1 for p in partitions or [] if p not in resume}
        held = fresh | {p: o + 1 for p, o in resume.items()}
        out["startingOffsets"] = json.dumps({source.topic: {str(p): o for p, o in sorted(held.items())}})
    elif source.start_ms is not None:
        out["startingTimestamp"] = str(source.start_ms)
        out["startingOffsetsByTimestampStrategy"] = "error" if reset == "earliest" else "latest"
    else:
        out["startingOffsets"] = reset
    return out


def read_kafka(spark: SparkSession, uri: str, schema: str | T.StructType, resume: dict[int, int] | None = None, partitions: list[int] | None = None) -> DataFrame:
    """A stream of Arrow IPC messages as rows of `schema` (needs Spark's Kafka connector); to resume, name all partitions."""
    want = parse_schema(schema) if isinstance(schema, str) else schema
    raw = spark.readStream.format("kafka").options(**kafka_options(parse_kafka_uri(uri), resume, partitions)).load()
    return decode_arrow(raw, "value", want)


def decode_arrow(df: DataFrame, column: str, want: T.StructType) -> DataFrame:
    """Rows of Arrow IPC streams held in a binary column; columns go by name, extra ones are left out."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    names, target = [f.name for f in want], to_arrow_schema(want)

    def run(batches):
        for batch in batches:
            for message in batch.column(0):
                if message.as_py() is None:
                    continue
                with pa.ipc.open_stream(message.as_buffer()) as reader:
                    project_by_name(from_arrow_schema(reader.schema), want)
                    for part in reader:
                        yield part.select(names).cast(target)

    return df.select(column).mapInArrow(run, want)


def encode_arrow(rows: DataFrame, columns: list[str], rows_each: int = 1024) -> DataFrame:
    """(value): the rows as Arrow IPC messages of at most `rows_each` rows, as producers write them; executors encode their own."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_each):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(lo, rows_each))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["value"])

    return rows.select(*columns).mapInArrow(run, "value binary")


# --- bundles: several tables that become visible together ------------------------------


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str, generation: str, info: dict | None = None) -> None:
    """Write all tables of a generation, then its manifest; a generation without one was not completed."""
    base = f"{path.rstrip('/')}/{generation}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    manifest = {"generation": generation, "tables": sorted(tables), "info": info or {}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{base}/manifest")


def read_bundle(spark: SparkSession, path: str, generation: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and info of a completed generation."""
    base = f"{path.rstrip('/')}/{generation}"
    try:
        row = spark.read.text(f"{base}/manifest").first()
    except Exception as e:
        raise FileNotFoundError(f"{base} has no manifest: it was not completed") from e
    if row is None:
        raise FileNotFoundError(f"{base} has no manifest: it was not completed")
    manifest = json.loads(row["value"])
    return {n: spark.read.parquet(f"{base}/{n}") for n in manifest["tables"]}, manifest["info"]
