"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are long, so batches between the JVM and Python are bounded by rows and by bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Tables are broadcast up to about so many bytes, by their counted rows and text; beyond, their joins shuffle.
BROADCAST_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and make sure that checkpoint() has a folder.

    The folder is the one that the cluster names in spark.checkpoint.dir; only
    where that is unset, as in tests, a temporary one is made, which needs a
    local master: executors elsewhere would not see it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veldt-checkpoint-"))
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until the table has no such column."""
    while name in df.columns:
        name += "_"
    return name


def saved(df: DataFrame, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """A checkpoint of the table, in few files where it is known to have at most `rows` rows.

    Every file that an executor writes has a price: on a local file system
    Hadoop starts a process to set its mode, and a store of objects answers a
    request for each.  A shuffle of a small table into many partitions would
    write as many files.
    """
    return (df if rows is None else df.coalesce(max(1, -(-rows // each)))).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet beside the checkpoints: for rows of many small numbers far smaller than a checkpoint."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_side(small: DataFrame, rows: int, row_bytes: int = 32) -> DataFrame:
    """The side of a join as a broadcast, where `rows` of about `row_bytes` each stay within BROADCAST_BYTES."""
    return F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small


def drop_rows(docs: DataFrame, found: DataFrame, group: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those of `found` (id, row, kept, *group) that are not kept, and with one kept row of each group.

    `row` is the hash of a document's text, so that only the names of rows are
    joined, by anti join: documents are not shuffled while the dropped names
    are few enough for a broadcast.  Kept rows that share an id and a group are
    one document: the one of the smallest hash stays, once.
    """
    found = found.select("id", "row", "kept", *group).checkpoint()
    doubles = saved(found.where("kept").groupBy("id", *group).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    gone = found.where("not kept").select("id", "row")
    rows = docs.withColumn(name := free_name(docs, "__row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    some = doubles.first() is not None
    if some:
        on = [found[c].eqNullSafe(doubles[c]) for c in ("id", *group)]
        gone = gone.unionByName(found.join(doubles, on).where("kept and row <> first").select(found["id"], "row"))
    gone = saved(gone.distinct())
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col("id").cast("string"))), F.lit(0)).alias("chars")).first()
    named = lambda names, n: small_side(names.withColumnsRenamed({"id": "g_id", "row": "g_row"}), n)
    on = rows[id_col].eqNullSafe(F.col("g_id")) & (F.col(name) == F.col("g_row"))
    kept = rows.join(named(gone, size["n"] + size["chars"] // 32), on, "left_anti")
    if some:
        once = named(saved(doubles.select("id", F.col("first").alias("row")).distinct()), 1 << 40)
        kept = kept.join(once, on, "left_anti").unionByName(kept.join(once, on, "left_semi").dropDuplicates([id_col, name]))
    return kept.drop(name)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a plan's sources; those without one, as checkpoints, count nothing.

    Estimates of whole plans won't do: Catalyst takes a join for as large as the product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 56)


def bucket_count(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many hash buckets bring one bucket's share of the input to about `bytes_each`."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-input_bytes(df) // bytes_each))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
