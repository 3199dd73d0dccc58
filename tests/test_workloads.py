"""Every query with SQL gives the same rows in Spark and in DuckDB on the smallest given tables."""

import math
from pathlib import Path

import pytest

from workloads import everything

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
WORK = everything()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def test_every_sql_belongs_to_a_query():
    assert set(WORK.sql) <= set(WORK.queries) and len(WORK.sql) > 60


@pytest.mark.parametrize("name", sorted(WORK.sql))
def test_same_rows(spark, sql, name):
    found = WORK.queries[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    cursor = sql.execute(WORK.sql[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found.collect())
    assert got == want
