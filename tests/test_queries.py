"""Every query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name not in entry.oracle_sql():
        assert rows
        return
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.columns, rows) == plain(columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_narrow_plans(spark):
    """No Python and no shuffle beyond the spreading of a small input; unread columns stay unread."""
    from markloom.plans.queries import QUERIES

    for name in ("utf8_decode", "pre_full", "seq_match", "tok_tokens", "tok_histogram", "tok_error"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "hashpartitioning" not in plan, name
        if name.startswith("tok"):
            assert "url" not in plan
