"""The driver's contract, with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from veldt.plans import catalog

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    assert entry.entry(spark).columns == ["grouped_auc"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 4)
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = tables.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_without_corpus_subpackage(tmp_path):
    """The rest imports and lists its queries when the corpus folders are gone."""
    for p in ("veldt", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{p}") else shutil.copy)(f"{REPO}/{p}", tmp_path / p)
    shutil.rmtree(tmp_path / "veldt/llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], out.stderr
