"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import decimal
import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if v is None or v is pd.NaT:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NULL" if v != v else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.12g}"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def views():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA / f}'")
    return con


@pytest.fixture(autouse=True)
def swept(spark):
    yield
    from loomlake.session import sweep

    sweep(spark)


def test_names_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


ORACLE = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, views, name):
    df = entry.queries()[name](spark, str(DATA))
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    cur = views.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert sorted(cols) == sorted(df.columns) and got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    """Rows and a schema without repeated names; what they hold is tested operator by operator."""
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = entry.queries()[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
