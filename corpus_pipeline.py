"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept and returns a DataFrame, which is stored as Parquet and read again as the
next stage's `docs`.  All but the last return the columns of `documents`.

A document is named by its id and a hash of its text: ids may be null, repeat,
or be strings, and texts may be null, empty or very long in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import exact_dedup, line_crf, mixing, ngram_join, packing
from veldt.llm.session import drop_rows, prepare, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go.

    Null and empty texts go (they have fewer than 50 words); every other row is
    judged by its own text alone, so rows that repeat share their fate and ids
    do not matter; an empty table stays empty.
    """
    prepare(spark)
    field = line_crf.train_field(docs, read_table(spark, sf_dir, "labels"))
    return line_crf.label_lines(docs, field, keep=docs.columns, only_kept=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: that of the smallest id, a null id only where there is no other.

    Null and empty texts are equal to each other.  Of several rows with that id
    one stays; rows of one id with different texts are different documents; an
    empty table stays empty.
    """
    found = exact_dedup.exact_dedup(docs).where("group_size > 1")
    return drop_rows(docs, found, ["digest", "keep_id"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link one row stays: that of the smallest id, a null id only where there is no other.

    Texts without words are linked with nothing and stay; rows of one id with
    different texts are different documents; an empty table stays empty.
    """
    found = ngram_join.ngram_join(docs).where("group_size > 1")
    return drop_rows(docs, found, ["root"])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document is cut to the words taken, once per epoch.

    Texts without words are never taken.  Rows that repeat, have no id or no
    source are documents like others; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences.

    Null and empty texts are the end token alone; rows that repeat or have no
    id are packed each; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: Viterbi labels, keyed permutations and evolved packings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; stages are stored in the shared checkpoint folder."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
