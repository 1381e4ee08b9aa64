"""Every query against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

from wildgrid.plans.fixtures import TABLES
from wildgrid.plans.registry import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 9) + 0.0) if v != int(v) else str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_without_text_operators(spark, sf_dir):
    import __spark_entry__ as e

    names = e.queries()
    assert set(QUERIES) <= set(names)
    assert set(e.oracle_sql()) <= set(names)
