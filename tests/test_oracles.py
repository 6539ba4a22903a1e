"""Every registered retail query against DuckDB on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from quillmart.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    if name not in SQL:
        assert got
        return
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
