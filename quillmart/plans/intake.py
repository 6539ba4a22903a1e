"""Queries of intake: rows that break a contract, manifests as text, evolving schemas, guarded rewinds, mappings of every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, date_key, standardize_order_status, standardize_payment_status
from ..operators import hashing, quality
from ..sources import commits, ledger, scans
from ..sources.contracts import EVENTS, TableContract
from . import contracts as k
from . import model as m
from .ingest import DAY, bronze_by_day, committed_days, events, scratch
from .registry import ORDERS, query

D = "double"

# --- rows against a contract ----------------------------------------------------
BROKEN = TableContract("broken", ("event_id",), "ts", "event_id bigint NOT NULL, ts timestamp_ntz NOT NULL, user_id bigint NOT NULL, event_type string NOT NULL, value double NOT NULL", domains={"event_type": ("view", "click", "signup", "purchase")}, minimums={"value": 1})
BROKEN_SQL = """b AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 1 ELSE event_id END AS event_id, event_id AS raw_id, ts, CASE WHEN event_id % 83 = 0 THEN NULL ELSE user_id END AS user_id,
        CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 79 = 0 THEN 'much' ELSE CAST(value AS VARCHAR) END AS value FROM events),
    coded AS (SELECT raw_id, concat_ws(',', CASE WHEN event_id IS NULL THEN 'KEY_NULL' END, CASE WHEN event_id IS NOT NULL AND row_number() OVER (PARTITION BY event_id ORDER BY ts) > 1 THEN 'BATCH_DUPLICATE' END, CASE WHEN event_id IS NULL THEN 'REQUIRED_NULL' END,
        CASE WHEN user_id IS NULL THEN 'REQUIRED_NULL' END, CASE WHEN event_type IS NULL THEN 'REQUIRED_NULL' END, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN 'TYPE_MISMATCH' END, CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'STATUS_DOMAIN_INVALID' END,
        CASE WHEN try_cast(value AS DOUBLE) < 1 THEN 'NUMERIC_RANGE_INVALID' END) AS codes FROM b)"""


def broken_events(spark: SparkSession, sf: str) -> DataFrame:
    """events with null and repeated keys, missing values and words for numbers over the whole table."""
    off = lambda n: F.col("event_id") % n == 0
    e = m.table(spark, sf, "events")
    return e.select(
        F.when(off(97), None).when(off(101), 1).otherwise(F.col("event_id")).alias("event_id"), "ts", F.when(off(83), None).otherwise(F.col("user_id")).alias("user_id"),
        F.when(off(89), None).otherwise(F.col("event_type")).alias("event_type"), F.when(off(79), "much").otherwise(F.col("value").cast("string")).alias("value"),
    )


@query(f"WITH {BROKEN_SQL} SELECT codes, count(*) AS n_rows FROM coded GROUP BY 1")
def i1_broken_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = quality.validate(broken_events(spark, sf), BROKEN)
    return v.groupBy(F.array_join("_errors", ",").alias("codes")).agg(F.count("*").alias("n_rows"))


@query(f"WITH {BROKEN_SQL}, x AS (SELECT unnest(string_split(codes, ',')) AS code FROM coded WHERE codes <> '') SELECT code, count(*) AS n_rows FROM x WHERE code IN ('KEY_NULL', 'REQUIRED_NULL') GROUP BY 1")
def i1c_null_codes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.error_counts(quality.validate(broken_events(spark, sf), BROKEN)).filter(F.col("code").isin("KEY_NULL", "REQUIRED_NULL"))


@query("SELECT o_orderstatus AS raw, CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' END AS order_status, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' END AS payment_status, count(*) AS n_rows FROM orders GROUP BY ALL")
def b3_standard_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Source statuses in any case to the standard ones; an unknown one becomes null."""
    raw = F.col("o_orderstatus")
    order, pay = F.when(raw == "F", "Delivered").when(raw == "O", "SHIPPED").otherwise("lost"), F.when(raw == "F", "completed").when(raw == "O", "Pending").otherwise("lost")
    return m.table(spark, sf, "orders").groupBy(raw.alias("raw"), standardize_order_status(order).alias("order_status"), standardize_payment_status(pay).alias("payment_status")).agg(F.count("*").alias("n_rows"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') || '+00' END AS seen, printf('%d.%02d', CAST(round(o_totalprice * 100) AS BIGINT) // 100, CAST(round(o_totalprice * 100) AS BIGINT) % 100) AS price, o_orderpriority AS "Prio" FROM orders),
    j AS (SELECT to_json({Prio: "Prio", id: id, price: price, seen: seen})::VARCHAR AS row_json FROM o) SELECT row_json, sha256(row_json) AS row_sha256 FROM j""")
def h14_canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical JSON of rows with timestamps, decimals and nulls."""
    o = m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("seen"), m.money(F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("Prio"))
    return o.select(canonical_json(o).alias("row_json")).withColumn("row_sha256", F.sha2("row_json", 256))


@query("""SELECT slice, count(*) AS n_rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, LEAST(4, o_orderkey * 5 // ((SELECT max(o_orderkey) FROM orders) + 1)) AS slice FROM orders) GROUP BY 1""")
def a3_snapshot_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A bounded snapshot read in slices of the key: each row falls in exactly one."""
    o = m.table(spark, sf, "orders").select("o_orderkey")
    parts = [o.filter(p).select(F.lit(i).cast("bigint").alias("slice"), "o_orderkey") for i, p in enumerate(scans.slices(o, "o_orderkey", 5))]
    return reduce(DataFrame.unionByName, parts).groupBy("slice").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


# --- batches ----------------------------------------------------------------------
@query(f"""WITH d AS (SELECT {DAY} AS batch_id, row_number() OVER (ORDER BY {DAY}) AS i, count(*) AS n FROM events GROUP BY 1)
    SELECT batch_id, CASE WHEN i % 5 = 0 THEN 'MISSING' WHEN i % 5 = 1 THEN 'TYPE' WHEN i % 5 = 2 THEN 'NOT_UTC' ELSE '' END AS reasons, CASE WHEN i % 5 > 1 THEN n END AS n_rows FROM d""")
def a12_manifest_text(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests as JSON text, some without a field, with a word for a number, or with a time that does not say UTC."""
    n = events(spark, sf).groupBy(F.date_format("ts", "yyyyMMdd").alias("batch_id")).agg(F.count("*").alias("n"))
    # A row for each batch.
    from pyspark.sql import Window as W

    i = F.row_number().over(W.orderBy("batch_id")) % 5
    at = F.when(F.col("i") == 2, "2024-02-01T00:00:00").otherwise("2024-02-01T00:00:00Z")
    rows = F.when(F.col("i") == 1, F.lit('"many"')).otherwise(F.col("n").cast("string"))
    rest = F.when(F.col("i") == 0, F.lit("")).otherwise(F.concat(F.lit(', "n_rows": '), rows))
    text = n.withColumn("i", i).select("batch_id", F.concat(F.lit('{"batch_id": "'), F.col("batch_id"), F.lit('", "written_at": "'), at, F.lit('"'), rest, F.lit("}")).alias("manifest"))
    return ledger.parse_manifests(text, {"batch_id": "string", "n_rows": "bigint"}, "written_at").select("batch_id", F.array_join("reasons", ",").alias("reasons"), F.col("fields.n_rows").alias("n_rows"))


@query(f"SELECT {DAY} AS batch_id, count(*) AS n_rows, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n_with_value, count(DISTINCT user_id) AS n_users FROM events WHERE {DAY} <> '20240105' GROUP BY 1")
def a16_evolved_source(spark: SparkSession, sf: str) -> DataFrame:
    """Committed batches of two versions read as one: a column that older files lack is null there."""
    path, e = scratch(spark), events(spark, sf).withColumn("batch_id", F.date_format("ts", "yyyyMMdd"))
    e.filter("batch_id < '20240116'").drop("value").write.partitionBy("batch_id").parquet(path)
    e.filter("batch_id >= '20240116'").write.mode("append").partitionBy("batch_id").parquet(path)
    catalog = e.select("batch_id").distinct().filter("batch_id <> '20240105'")
    got = ledger.bronze_source(spark, path, catalog, e.schema)
    return got.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_with_value"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT source_table, CAST(schema_version AS INTEGER) AS schema_version, n_objects FROM (SELECT 'events' AS source_table, 9 AS schema_version, count(DISTINCT strftime(ts, '%Y%m%d')) FILTER (day(ts) % 6 = 0) AS n_objects FROM events)")
def a17_unsupported_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = committed_days(bronze_by_day(spark, sf)).withColumn("schema_version", F.when(F.substring("batch_id", 7, 2).cast("int") % 6 == 0, 9).otherwise(F.col("schema_version")))
    return ledger.unsupported_versions(rows)


@query("SELECT event_id, user_id, value FROM events WHERE ts < TIMESTAMP '2024-01-03'")
def a18_empty_and_first_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A table without batches is empty and typed, so that it can stand beside one with batches."""
    return ledger.empty_relation(spark, EVENTS).unionByName(events(spark, sf).filter(F.col("ts") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))).select("event_id", "user_id", "value")


@query("SELECT '20240115' AS watermark, 3 AS version, true AS dry_run_kept, count(DISTINCT strftime(ts, '%Y%m%d')) AS n_committed FROM events WHERE strftime(ts, '%Y%m%d') <= '20240130'")
def a8_guarded_rewind(spark: SparkSession, sf: str) -> DataFrame:
    """The watermark moved back: only from where the caller saw it, as a new version, and not at all in a dry run."""
    book = commits.Ledger(spark, scratch(spark))
    book.commit(committed_days(bronze_by_day(spark, sf)), expected="", advance_to="20240130")
    start = book.version()
    book.rewind("20240116", expected="20240130", dry_run=True)
    kept = book.watermark() == "20240130" and book.version() == start
    if book.rewind("20240116", expected="20240101") is not None:
        raise AssertionError("a stale rewind was taken")
    book.rewind("20240120", expected="20240130")
    book.rewind("20240116", expected="20240119")
    return book.rows().agg(F.count("*").alias("n_committed")).select(F.lit(book.watermark()).alias("watermark"), F.lit(book.version()).alias("version"), F.lit(kept).alias("dry_run_kept"), "n_committed")


@query(f"""SELECT CASE WHEN {DAY} > '20240125' THEN 'RUN' WHEN {DAY} = '20240110' OR {DAY} = '20240111' OR {DAY} = '20240112' THEN 'CONFLICT' ELSE 'SKIP' END AS decision, count(DISTINCT {DAY}) AS n_batches FROM events GROUP BY 1""")
def a22_reuse_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """Batches asked for again, compared by rows, hash, cursor range and schema version."""
    bronze = bronze_by_day(spark, sf)
    extra = ledger.batch_manifest(bronze, EVENTS).select("batch_id", F.to_json("last_cursor").alias("last_cursor"))
    rows = committed_days(bronze).join(extra, "batch_id")
    off = lambda c, day, x: F.when(F.col("batch_id") == day, x).otherwise(F.col(c)).alias(c)
    asked = rows.select("source_table", "batch_id", off("row_count", "20240110", F.col("row_count") + 1), "logical_hash", off("last_cursor", "20240111", F.lit("{}")), off("schema_version", "20240112", F.lit(1)))
    return ledger.batch_reuse(asked, rows.filter("batch_id <= '20240125'"), ("last_cursor", "schema_version")).groupBy("decision").agg(F.count("*").alias("n_batches"))


@query(f"SELECT {DAY} AS batch_id, {DAY} <> '20240127' AND {DAY} <> '20240128' AND {DAY} <> '20240129' AS accept, CASE {DAY} WHEN '20240127' THEN 'SCHEMA_VERSION' WHEN '20240128' THEN 'RUN_STATE' WHEN '20240129' THEN 'CURSOR_RANGE' ELSE '' END AS reasons FROM events GROUP BY {DAY} HAVING {DAY} > '20240125'")
def a25_reconcile_in_full(spark: SparkSession, sf: str) -> DataFrame:
    """Written but uncommitted batches against their manifests and runs: version, cursor range and run state count too."""
    man = ledger.batch_manifest(bronze_by_day(spark, sf), EVENTS)
    rows = ledger.commit_rows(man, EVENTS, F.lit(None).cast("timestamp")).join(man.select("batch_id", "first_cursor", "last_cursor"), "batch_id")
    orphans = ledger.orphan_objects(rows, rows.filter("batch_id <= '20240125'"))
    runs = rows.select("batch_id", F.when(F.col("batch_id") == "20240128", "FAILED").otherwise("SUCCESS").alias("status"))
    man = man.withColumns({"schema_version": F.when(F.col("batch_id") == "20240127", 1).otherwise(F.col("schema_version")), "last_cursor": F.when(F.col("batch_id") == "20240129", F.col("first_cursor")).otherwise(F.col("last_cursor"))})
    return ledger.reconcile_orphans(orphans, man, F.lit("20240125"), runs).select("batch_id", "accept", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT state, count(*) AS n_batches FROM (SELECT CASE {DAY} WHEN '20240105' THEN 'MISSING' WHEN '20240106' THEN 'SCHEMA_VERSION' ELSE 'COMMITTED' END AS state FROM events GROUP BY {DAY}) GROUP BY 1")
def a23_verify_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Batches asked for with the schema version that the reader expects."""
    rows = committed_days(bronze_by_day(spark, sf))
    kept = rows.filter("batch_id <> '20240105'").withColumn("schema_version", F.when(F.col("batch_id") == "20240106", 1).otherwise(F.col("schema_version")))
    runs = rows.select("source_table", "batch_id", F.lit(1).alias("attempt"), F.lit("FAILED").alias("status"))
    asked = rows.select("source_table", "batch_id", "schema_version")
    return commits.verify(asked, kept, runs).groupBy("state").agg(F.count("*").alias("n_batches"))


# --- totals, mappings, metrics ---------------------------------------------------------
@query(f"WITH {ORDERS} SELECT order_id FROM orders_m WHERE order_id % 19 = 0")
def i15_payments_match_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose payments differ from their value by more than a cent, two cents added to some."""
    off = F.when((F.col("order_id") % 19 == 0) & (F.col("payment_sequence") == 1), F.expr("0.02BD")).otherwise(F.expr("0.00BD"))
    pay = k.order_payments(spark, sf).withColumn("payment_value", F.col("payment_value") + off)
    return quality.totals_match(m.stg_orders(spark, sf), pay, "order_id", "order_value", "payment_value", "0.01").select("order_id")


#: Tables, their keys and the mapped columns; in each every 13th key is spoilt in the first column.
MAPPED = {
    "region": ("r_regionkey", ["r_name"]), "nation": ("n_nationkey", ["n_name", "n_regionkey"]), "customer": ("c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]), "supplier": ("s_suppkey", ["s_name", "s_nationkey"]),
    "part": ("p_partkey", ["p_brand", "p_type", "p_size"]), "orders": ("o_orderkey", ["o_orderstatus", "o_custkey", "o_orderpriority"]), "events": ("event_id", ["event_type", "user_id"]), "documents": ("doc_id", ["lang", "source"]), "labels": ("doc_id", ["quality"]),
}


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, " + (f"count(*) FILTER ({key} % 13 = 0)" if i == 0 else "count(*) FILTER (false)") + f" AS n_rows FROM {t}" for t, (key, columns) in MAPPED.items() for i, c in enumerate(columns)))
def i20_all_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Each staged column of nine tables against its source."""
    out = []
    for t, (key, columns) in MAPPED.items():
        source = m.table(spark, sf, t).select(key, *columns)
        first = F.when(F.col(key) % 13 == 0, F.lit(None)).otherwise(F.col(columns[0]))
        staged = source.select(F.col(key).alias("k"), first.alias(f"t_{columns[0]}"), *[F.col(c).alias(f"t_{c}") for c in columns[1:]])
        diff = quality.mapping_differences(staged, source.withColumnRenamed(key, "k"), "k", {f"t_{c}": c for c in columns})
        out.append(diff.select(F.concat(F.lit(f"{t}."), F.substring("column_name", 3, 100)).alias("column_name"), "n_rows"))
    return reduce(DataFrame.unionByName, out)


@query(f"""WITH {k.PAYMENTS}, {k.VERSIONS} SELECT 'gmv' AS metric, order_date_key AS day FROM orders_m WHERE order_id % 997 = 0 GROUP BY 2
    UNION ALL SELECT 'paid', CAST(strftime(purchase_at, '%Y%m%d') AS INTEGER) FROM payments WHERE payment_sequence = 2 AND payment_status = 'COMPLETED' AND order_id % 31 = 0 GROUP BY 2
    UNION ALL SELECT 'changes', CAST(strftime(updated_at, '%Y%m%d') AS INTEGER) FROM versions WHERE customer_id % 50 = 0 GROUP BY 2""")
def i21_three_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which a metric differs from the same computed from its fact: order value, completed payments, changes of state."""
    orders = m.stg_orders(spark, sf).select("order_id", date_key(F.col("purchase_at")).alias("day"), F.col("order_value").alias("x"))
    pay = k.order_payments(spark, sf).filter("payment_status = 'COMPLETED'").select("order_id", "payment_sequence", date_key(F.col("purchase_at")).alias("day"), F.col("payment_value").alias("x"))
    states = m.dim_customer_state(spark, sf).select("customer_id", date_key(F.col("updated_at")).alias("day"), F.lit(1).alias("x"))
    daily = lambda df: df.groupBy("day").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    pairs = {"gmv": (orders, "order_id % 997 <> 0"), "paid": (pay, "NOT (payment_sequence = 2 AND order_id % 31 = 0)"), "changes": (states, "customer_id % 50 <> 0")}
    out = [quality.reconcile(daily(df), daily(df.filter(rest)), ["day"], ["total", "n"]).select(F.lit(name).alias("metric"), "day") for name, (df, rest) in pairs.items()]
    return reduce(DataFrame.unionByName, out)


@query("""SELECT 'left_only' AS status, count(*) AS n_rows, string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (r <= 3) AS sample FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 10 = 0)
    UNION ALL SELECT 'changed', count(*), string_agg(p_partkey, ',' ORDER BY p_partkey) FILTER (r <= 3) FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 = 0)""")
def l5_difference_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of two tables differ and in which way, with the first keys of each."""
    left = m.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size")
    right = left.filter("k % 10 <> 0").withColumn("p_size", F.col("p_size") + (F.col("k") % 11 == 0).cast("int"))
    return hashing.difference_summary(hashing.keyed_difference(left, right, ["k"]), "k", 3)
