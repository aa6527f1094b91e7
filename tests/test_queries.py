"""Every registered query with SQL, at the smallest scale, against DuckDB; the rest must give rows."""

from pathlib import Path

import pytest

from strandline.plans import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, str(SF))
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    result = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_flagship(spark):
    rows = queries.flagship(spark, str(SF)).collect()
    assert rows and all(r.start <= r.end and 0 <= r.ratio <= 1 for r in rows)
