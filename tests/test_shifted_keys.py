"""Queries that add rows under shifted keys, on tables whose own keys reach that far."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmart.plans import all_queries

QUERIES, SQL = all_queries()
SF = "/root/testdata/sf0.001"


def agrees(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    rel, df = con.sql(SQL[name]), QUERIES[name](spark, sf)
    got = sorted(tuple(r) for r in df.select(*rel.columns).collect())
    assert got == sorted(rel.fetchall())
    return got


@pytest.fixture
def parts(spark, tmp_path):
    """Parts numbered from 0 and, as many, from the number that added rows begin at."""
    part = spark.read.parquet(f"{SF}/part.parquet").limit(1).drop("p_partkey")
    keys = spark.range(3000).select(F.when(F.col("id") < 1500, F.col("id")).otherwise(F.col("id") + 998_500).alias("p_partkey"))
    keys.crossJoin(part).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_upserted_rows_of_another_source_replace_no_part(spark, parts):
    got = agrees(spark, parts, "a28_upsert", ["part"])
    assert len([b for k, b in got if k == 1_000_700]) == 2


def test_rows_added_to_one_side_are_told_from_parts_of_their_number(spark, parts):
    got = agrees(spark, parts, "l5_keyed_difference", ["part"])
    assert [x for k, x in got if k == 1_000_001] == ["right_only"] and len([k for k, _ in got if k == 1_000_010]) == 1


def orders_at(spark, tmp_path, shift):
    """Orders as given and, as many, under keys that are shifted."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionByName(orders.withColumn("o_orderkey", F.col("o_orderkey") + shift)).write.parquet(f"{tmp_path}/orders.parquet")
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_orders_added_to_one_side_are_told_from_orders_of_their_number(spark, tmp_path):
    agrees(spark, orders_at(spark, tmp_path, 1_000_000_000), "l5_tree_difference", ["orders"])


def test_keys_moved_out_of_range_meet_no_order(spark, tmp_path):
    agrees(spark, orders_at(spark, tmp_path, 10_000_000), "i17_affected_keys_resolve", ["orders", "lineitem", "part"])
