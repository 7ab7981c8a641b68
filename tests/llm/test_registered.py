"""Every registered query on odd and on empty tables, and against its SQL."""

import duckdb
import pytest

from veldt.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op1_", "op13_"))))
def test_odd_tables(spark, stored, name):
    rows = QUERIES[name](spark, stored).collect()
    ids = sorted(r["doc_id"] for r in rows)
    if name.startswith("op2_"):
        assert sorted(r["doc_id"] for r in rows if r["piece"] == 0) == [*range(1, 8), *range(7, 14)]
    elif not name.startswith("op7_"):
        assert ids == [*range(1, 8), *range(7, 14)]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op1_", "op13_"))))
def test_odd_ids(spark, stored_ids, odd_ids, name):
    """Null, repeated and very large ids lose no row."""
    from collections import Counter

    got, want = Counter(r["doc_id"] for r in QUERIES[name](spark, stored_ids).collect()), Counter(r["doc_id"] for r in odd_ids.select("doc_id").collect())
    if name.startswith("op2_"):
        assert set(got) == set(want) and all(got[i] >= n for i, n in want.items())
    elif name.startswith("op7_"):
        assert set(got) <= set(want)
    else:
        assert got == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("place", ["stored", "given"])
def test_against_sql(spark, request, name, place):
    d = request.getfixturevalue("stored") if place == "stored" else "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet{'/*.parquet' if place == 'stored' else ''}'")
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    if name.startswith("op13_"):
        d = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    want = con.sql(ORACLE_SQL[name]).select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    # SQL joins repeated rows of one id with one another
    assert sorted(set(got), key=str) == sorted(set(want), key=str)
