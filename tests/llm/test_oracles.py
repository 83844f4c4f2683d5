import glob
import os

import duckdb
import pytest

from textlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str)
    assert got == sorted(sql.fetchall(), key=str)
