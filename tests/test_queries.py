"""Every registered query of the base library against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from textlens import queries, table_queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got = df.collect()
    sql = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    want = sql.fetchall()
    assert len(want) > 0
    assert plain(got, df.columns) == plain(want, columns)
