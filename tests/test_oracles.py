"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyweave.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return str(list(v)) if isinstance(v, list) else v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    got = df.collect()
    assert df.columns
    if name not in registry.ORACLE_SQL:
        assert got
        return
    told = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in told.fetchall()]
    key = lambda rows: sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert key(got) == key(want)
