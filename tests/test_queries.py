import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factorloom import queries as core

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()
CORE = list(core.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    assert sorted(c[0] for c in found.description) == columns
    order = [[c[0] for c in found.description].index(c) for c in columns]
    key = lambda row: tuple((v is None, v) for v in row)
    wanted = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == wanted


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
