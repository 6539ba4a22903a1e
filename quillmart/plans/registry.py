"""Query registry: each query with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several oracles share.
STATUS_CASE = "CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' WHEN 'P' THEN 'PROCESSING' END"
ORDERS = f"""orders_m AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, {STATUS_CASE} AS order_status, o_orderdate AS purchase_at,
           CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS order_date_key, o_orderpriority AS priority FROM orders)"""
ITEMS = """items_m AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, l_shipdate AS shipped_at,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, (CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50) // 100 AS freight
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1)"""
VERSIONS = """obs AS (
    SELECT user_id AS customer_id, event_type AS state, ts AS updated_at, md5('state:' || length(event_type) || ':' || event_type) AS attribute_hash, strftime(ts, '%Y%m%d') AS batch_id
    FROM events WHERE event_type <> 'purchase'
    QUALIFY row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY event_id DESC) = 1),
changed AS (SELECT * FROM obs WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at) QUALIFY lag(attribute_hash) OVER w IS DISTINCT FROM attribute_hash),
versions AS (
    SELECT *, row_number() OVER w AS version, updated_at AS valid_from, CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '0001-01-01' ELSE updated_at END AS effective_from,
           lead(updated_at) OVER w AS valid_to, lead(updated_at) OVER w IS NULL AS is_current,
           md5(customer_id || '|' || strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') || '+00' || '|' || attribute_hash) AS customer_key
    FROM changed WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at))"""


def lookup(prefix: str) -> list[str]:
    return [k for k in QUERIES if k.startswith(prefix)]
