import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i} and more" for i in range(20_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, "   \n\t ", "en", "a", 6), (4, "Same text here for all of them", "en", "b", 1), (5, "same  text HERE for all\nof them", "en", "b", 1),
        (6, "Same text  here for all of them", "de", None, 1), (7, "Same text  here for all of them", "de", None, 1), (7, "Same text  here for all of them", "de", None, 1), (8, long, "en", "a", 1),
        (9, "é ü ß 日本語 \x0b vertical\x0ctabs", "fr", "é", 1), (10, "a", "en", "z", 1), (11, "x\n" * 300, "en", "z", 1), (12, "nowhitespace" * 3000, "en", "z", 1), (13, "1 2 3 <|endoftext|> 4", "en", "z", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clashing = ("id", "h", "norm", "digest", "rank", "ranges", "epoch", "base", "terms", "kept", "n", "sid", "root", "label", "__id", "__text", "bucket", "size")
    return df.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="session")
def odd_ids(odd, spark):
    """The odd documents and rows whose ids are null, repeated with other texts, and very large."""
    rows = [
        (None, "lost text of a row without an id", "en", "a", 1), (None, "Same text  here for all of them", "en", None, 1), (None, "only rows without an id have this", "en", "a", 1), (None, "only rows  without an id have this", "en", "a", 1),
        (7, "another text under the id of others", "en", "b", 1), (7, "Same text here  for all of them", "en", "b", 1), (2**62 + 5, "far away", "en", "b", 1), (2**62 + 6, "far  away", "en", "b", 1), (-(2**63), "far   away", "en", "b", 1),
    ]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)


@pytest.fixture
def stored(odd, spark, tmp_path_factory):
    """A folder with the odd documents as tables, for registered queries."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture
def stored_ids(odd_ids, spark, tmp_path_factory):
    """A folder like `stored` with the documents of odd ids."""
    d = str(tmp_path_factory.mktemp("ids"))
    odd_ids.write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture
def empty(odd, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d
