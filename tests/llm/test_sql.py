import glob
import os

import duckdb
import pytest

from factorloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    key = lambda row: tuple((v is None, v) for v in row)
    wanted = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == wanted
