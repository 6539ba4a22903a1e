"""Queries of seed checks, commits, verification, run reports and serving exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, date_key, ratio
from ..operators import hashing, quality
from ..operators.history import date_dimension, keep_first, newest
from ..sources import commits, ledger, scans
from ..sources.contracts import EVENTS
from . import model as m
from . import observability as obs
from .ingest import AFFECTED, affected_orders, bronze_by_day, committed_days, events, scratch
from .registry import ITEMS, ORDERS, VERSIONS, query

D = "double"
DAY = "strftime(ts, '%Y%m%d')"


# --- parsing, derivations, constraints ------------------------------------------
@query("""SELECT 'c_name' AS column_name, count(*) AS n_bad FROM customer WHERE try_cast(c_name AS INTEGER) IS NULL UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE try_cast(c_mktsegment AS TIMESTAMP) IS NULL
    UNION ALL SELECT 'c_custkey', 0""")
def b15_strict_parse(spark: SparkSession, sf: str) -> DataFrame:
    raw = m.table(spark, sf, "customer").select(*[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_mktsegment")])
    return quality.unparsable(raw, {"c_custkey": "bigint", "c_name": "int", "c_mktsegment": "timestamp"})


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'PENDING' END AS payment_status, count(*) AS n_payments, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100 AS payment_value FROM orders GROUP BY 1")
def b16_seed_derivations(spark: SparkSession, sf: str) -> DataFrame:
    """A payment for each order, its status derived from the order's and its creation from the purchase."""
    status = F.when(F.col("order_status") == "DELIVERED", "COMPLETED").when(F.col("order_status") == "PROCESSING", "FAILED").otherwise("PENDING")
    pay = m.stg_orders(spark, sf).select("order_id", status.alias("payment_status"), F.col("purchase_at").alias("created_at"), F.col("order_value").alias("payment_value"))
    return pay.groupBy("payment_status").agg(F.count("*").alias("n_payments"), F.sum("payment_value").cast(D).alias("payment_value"))


@query(f"""WITH {VERSIONS} SELECT customer_id, state FROM versions WHERE is_current AND (state = 'error' OR updated_at < TIMESTAMP '2024-01-28' OR (state = 'signup' AND updated_at < TIMESTAMP '2024-01-30')) ORDER BY updated_at, customer_id""")
def b17_due_for_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """Current states that a pass must touch: failed, overdue, or a signup that has waited."""
    before = lambda t: F.col("updated_at") < F.lit(t).cast("timestamp_ntz")
    due = (F.col("state") == "error") | before("2024-01-28 00:00:00") | ((F.col("state") == "signup") & before("2024-01-30 00:00:00"))
    return m.dim_customer_state(spark, sf).filter(F.col("is_current") & due).orderBy("updated_at", "customer_id").select("customer_id", "state")


@query("""SELECT concat_ws(',', CASE WHEN l_discount > 0.09 THEN 'DISCOUNT' END, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'RETURN_OF_OPEN' END, CASE WHEN l_extendedprice < l_quantity THEN 'PRICE' END) AS violations, count(*) AS n_rows
    FROM lineitem GROUP BY 1""")
def b19_row_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"DISCOUNT": F.col("l_discount") > 0.09, "RETURN_OF_OPEN": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "PRICE": F.col("l_extendedprice") < F.col("l_quantity")}
    return quality.violations(m.table(spark, sf, "lineitem"), rules).groupBy(F.array_join("_violations", ",").alias("violations")).agg(F.count("*").alias("n_rows"))


# --- joins and aggregates --------------------------------------------------------
@query("""SELECT n_orders, n_customers, n_orders / n_customers AS orders_per_customer FROM (SELECT count(*) AS n_orders FROM orders) CROSS JOIN (SELECT count(*) AS n_customers FROM customer)""")
def c13_totals_of_one_row_each(spark: SparkSession, sf: str) -> DataFrame:
    o = m.table(spark, sf, "orders").agg(F.count("*").alias("n_orders"))
    c = m.table(spark, sf, "customer").agg(F.count("*").alias("n_customers"))
    return o.crossJoin(c).withColumn("orders_per_customer", ratio(F.col("n_orders"), F.col("n_customers")))


@query("""SELECT d AS domain, coalesce(n, 0) AS n_events, n IS NULL AS is_missing FROM (VALUES ('signup'), ('purchase'), ('refund')) t(d) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = d""")
def c18_expected_domains(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([("signup",), ("purchase",), ("refund",)], "domain string")
    n = m.table(spark, sf, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("n"))
    return expected.join(n, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n_events"), F.col("n").isNull().alias("is_missing"))


@query("SELECT o_custkey AS customer_id, o_orderkey AS order_id, row_number() OVER w AS depth, lead(o_orderkey) OVER w AS previous_order_id FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 5")
def c19_previous_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's last orders with the one before each: a linear chain cut at a depth."""
    w = W.partitionBy("customer_id").orderBy(F.desc("purchase_at"), F.desc("order_id"))
    o = m.stg_orders(spark, sf).withColumns({"depth": F.row_number().over(w), "previous_order_id": F.lead("order_id").over(w)})
    return o.filter("depth <= 5").select("customer_id", "order_id", F.col("depth").cast("long").alias("depth"), "previous_order_id")


@query("SELECT strftime(min(ts), '%Y-%m-%d') AS lo, strftime(max(ts), '%Y-%m-%d') AS hi, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n_days FROM events")
def d4_date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return date_dimension(m.table(spark, sf, "events"), "ts").agg(F.date_format(F.min("date_day"), "yyyy-MM-dd").alias("lo"), F.date_format(F.max("date_day"), "yyyy-MM-dd").alias("hi"), F.count("*").alias("n_days"))


@query("SELECT user_id AS customer_id, count(DISTINCT md5('state:' || length(event_type) || ':' || event_type)) AS n_hashes, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, ts::DATE AS d FROM events WHERE event_type <> 'purchase') GROUP BY user_id, strftime(ts, '%Y-%m-%d') HAVING count(DISTINCT event_type) > 1")
def d10_conflicting_states_by_day(spark: SparkSession, sf: str) -> DataFrame:
    o = m.observations(spark, sf).withColumn("day", F.date_format("updated_at", "yyyy-MM-dd"))
    return quality.conflicting_observations(o, "customer_id", "day", "attribute_hash")


@query(f"""WITH r AS (SELECT {DAY} AS batch_id, event_type AS source_table, user_id % 3 AS attempt, count(*) AS rows_loaded FROM events GROUP BY ALL)
    SELECT batch_id, sum(rows_loaded) AS rows_loaded, count(*) FILTER (rows_loaded < 10) AS n_small, max(attempt) AS max_attempt FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY batch_id, source_table ORDER BY attempt DESC) = 1) GROUP BY 1""")
def d19_latest_attempt_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = m.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("batch_id"), F.col("event_type").alias("source_table"), (F.col("user_id") % 3).alias("attempt")).agg(F.count("*").alias("rows_loaded"))
    last = keep_first(r, ["batch_id", "source_table"], newest("attempt"))
    return last.groupBy("batch_id").agg(F.sum("rows_loaded").alias("rows_loaded"), F.count_if(F.col("rows_loaded") < 10).alias("n_small"), F.max("attempt").alias("max_attempt"))


@query("SELECT to_json({n_name: n_name, n_nationkey: n_nationkey, n_regionkey: n_regionkey})::VARCHAR AS row_json, sha256(to_json({n_name: n_name, n_nationkey: n_nationkey, n_regionkey: n_regionkey})::VARCHAR) AS row_sha256 FROM nation")
def h14_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    n = m.table(spark, sf, "nation")
    return n.select(canonical_json(n).alias("row_json")).withColumn("row_sha256", F.sha2("row_json", 256))


# --- more checks -------------------------------------------------------------------
@query("SELECT l_orderkey AS order_id, count(*) AS n_lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate GROUP BY 1")
def i19_event_time_order(spark: SparkSession, sf: str) -> DataFrame:
    lines = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_shipdate")
    late = lines.join(m.stg_orders(spark, sf).select("order_id", "purchase_at"), "order_id").filter("l_shipdate < purchase_at")
    return late.groupBy("order_id").agg(F.count("*").alias("n_lines"))


@query(f"WITH {VERSIONS} SELECT state, count(*) AS n_open FROM versions WHERE is_current AND state IN ('signup', 'view') GROUP BY 1 HAVING count(*) > 1")
def i12_open_contracts(spark: SparkSession, sf: str) -> DataFrame:
    open_ = m.dim_customer_state(spark, sf).filter(F.col("is_current") & F.col("state").isin("signup", "view"))
    return quality.unique(open_, "state").withColumnRenamed("n_rows", "n_open")


@query(f"WITH {AFFECTED} SELECT order_id + 10000000 AS order_id FROM affected WHERE order_id % 5 = 0")
def i17_affected_keys_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Affected keys that no order has: every fifth of them is moved out of range."""
    # Below zero, where no order is: orders may reach beyond any number added.
    moved = F.when(F.col("order_id") % 5 == 0, -1 - F.col("order_id")).otherwise(F.col("order_id"))
    found = quality.relationships(affected_orders(spark, sf).select(moved.alias("order_id")), "order_id", m.table(spark, sf, "orders"), "o_orderkey")
    return found.select(F.when(F.col("order_id") < 0, 10_000_000 - 1 - F.col("order_id")).otherwise(F.col("order_id")).alias("order_id"))


@query("SELECT o_orderkey AS order_id FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def i16_conditional_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Rows where a value is set that its status does not allow, or missing that it needs."""
    o = m.stg_orders(spark, sf)
    value = F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), F.col("order_value"))
    return quality.set_exactly_when(o.withColumn("fast_value", value), "fast_value", F.col("order_status") == "DELIVERED").select("order_id")


@query("""SELECT check_name, n FROM (SELECT 'pk_null' AS check_name, count(*) AS n FROM orders WHERE o_orderkey IS NULL UNION ALL SELECT 'pk_repeated', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'no_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'after_seed', count(*) FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01')""")
def i26_seed_checks(spark: SparkSession, sf: str) -> DataFrame:
    o, c = m.table(spark, sf, "orders"), m.table(spark, sf, "customer")
    checks = {
        "pk_null": lambda: quality.not_null(o, "o_orderkey"), "pk_repeated": lambda: quality.unique(o, "o_orderkey"), "no_customer": lambda: quality.relationships(o, "o_custkey", c, "c_custkey"),
        "after_seed": lambda: o.filter(F.col("o_orderdate") > F.lit("2001-07-01 00:00:00").cast("timestamp_ntz")),
    }
    return quality.run_checks([quality.Check(k, "seed", f) for k, f in checks.items()]).select("check_name", F.col("n_violations").alias("n"))


@query(f"WITH {ORDERS}, {ITEMS} SELECT o.order_id FROM orders_m o JOIN (SELECT order_id, sum(cents + freight) AS c FROM items_m GROUP BY 1) t USING (order_id) WHERE abs(o.cents - t.c) > 50000000")
def i15_totals_differ(spark: SparkSession, sf: str) -> DataFrame:
    lines = m.fct_order_item(spark, sf)
    orders = m.stg_orders(spark, sf).join(lines.select("order_id").distinct(), "order_id", "left_semi")
    return quality.totals_match(orders, lines, "order_id", "order_value", "line_gross", "500000.00").select("order_id")


# --- commits and verification --------------------------------------------------------
@query(f"SELECT CASE WHEN {DAY} = '20240105' THEN 'MISSING' WHEN {DAY} = '20240107' THEN 'NO_DATA' ELSE 'COMMITTED' END AS state, count(DISTINCT {DAY}) AS n_batches FROM events GROUP BY 1")
def a23_verify_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch asked for is committed, or its last run found no data, or it is missing."""
    rows = committed_days(bronze_by_day(spark, sf))
    runs = rows.select("source_table", "batch_id", F.lit(1).alias("attempt"), F.when(F.col("batch_id") == "20240107", "SUCCESS_NO_DATA").otherwise("FAILED").alias("status"))
    kept = rows.filter(~F.col("batch_id").isin("20240105", "20240107"))
    return commits.verify(rows.select("source_table", "batch_id"), kept, runs).groupBy("state").agg(F.count("*").alias("n_batches"))


@query(f"SELECT '20240130' AS watermark, count(*) AS n_committed, sum(n) AS n_rows FROM (SELECT {DAY} AS b, count(*) AS n FROM events GROUP BY 1)")
def a14_commit_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Batches committed in two steps; each moves the watermark only if it stands where the step began."""
    rows, path = committed_days(bronze_by_day(spark, sf)), scratch(spark)
    first = commits.Ledger(spark, path)
    first.commit(rows.filter("batch_id <= '20240115'"), expected="", advance_to="20240115")
    first.commit(rows.filter("batch_id > '20240115'"), expected="20240115", advance_to="20240130")
    if first.commit(rows.limit(1), expected="20240115", advance_to="20240101"):
        raise AssertionError("a stale commit was taken")
    return first.rows().agg(F.count("*").alias("n_committed"), F.sum("row_count").alias("n_rows")).withColumn("watermark", F.lit(first.watermark()))


@query(f"SELECT {DAY} AS batch_id, count(*) AS n_rows, {DAY} <> '20240110' AS verified FROM events GROUP BY {DAY}")
def a26_verify_written(spark: SparkSession, sf: str) -> DataFrame:
    """Batches read again from storage against their manifests, one of which is off."""
    bronze = bronze_by_day(spark, sf)
    man = ledger.batch_manifest(bronze, EVENTS).withColumn("logical_hash", F.when(F.col("batch_id") == "20240110", "0").otherwise(F.col("logical_hash")))
    return commits.verify_written(bronze, man, EVENTS)


@query("SELECT 'old' AS side, count(*) AS n_rows FROM events WHERE ts <= TIMESTAMP '2024-01-20' UNION ALL SELECT 'both', count(*) FROM events")
def p3_full_and_incremental_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A full read, and an earlier read with its increment: the same rows by hash."""
    e = events(spark, sf)
    old = scans.incremental(e, EVENTS, None, ("2024-01-20 00:00:00", 10**12))
    new = scans.incremental(e, EVENTS, ("2024-01-20 00:00:00", 10**12), None)
    both = old.unionByName(new)
    same = hashing.logical_hash(both).join(hashing.logical_hash(e).select("logical_hash"), "logical_hash")
    return old.agg(F.count("*").alias("n_rows")).select(F.lit("old").alias("side"), "n_rows").unionByName(same.select(F.lit("both").alias("side"), "n_rows"))


@query("SELECT count(*) AS n_rows, true AS same_hash FROM supplier")
def p2_csv_and_parquet_hash(spark: SparkSession, sf: str) -> DataFrame:
    s, path = m.table(spark, sf, "supplier"), scratch(spark)
    scans.export_csv_mirror(s, path, ["s_suppkey"])
    a, b = hashing.logical_hash(s), hashing.logical_hash(scans.read_typed_csv(spark, path, s.schema)).select(F.col("logical_hash").alias("_h"))
    return a.crossJoin(b).select("n_rows", (F.col("logical_hash") == F.col("_h")).alias("same_hash"))


@query("""WITH r AS (SELECT event_type AS scenario, value AS seconds, user_id % 10 <> 0 AS valid FROM events) SELECT scenario, count(*) FILTER (valid) AS n_valid, quantile_cont(seconds, 0.5) FILTER (valid) AS median_seconds FROM r GROUP BY 1 HAVING count(*) FILTER (valid) >= 5""")
def p4_median_of_valid_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = m.table(spark, sf, "events").select(F.col("event_type").alias("scenario"), F.col("value").alias("seconds"), (F.col("user_id") % 10 != 0).alias("valid"))
    g = r.groupBy("scenario").agg(F.count_if("valid").alias("n_valid"), F.percentile(F.when(F.col("valid"), F.col("seconds")), 0.5).alias("median_seconds"))
    return g.filter("n_valid >= 5")


# --- run reports ------------------------------------------------------------------------
RUNS = "d AS (SELECT ts::DATE AS run_day, count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1), b AS (SELECT *, lag(n_rows) OVER (ORDER BY run_day) AS before FROM d), f AS (SELECT *, n_errors > 60 AS e, coalesce(n_rows < before * 0.99, false) AS r, n_rows > 340 AS s FROM b)"


@query(f"WITH {RUNS} SELECT CAST(strftime(run_day, '%Y%m%d') AS INTEGER) AS run_id, CASE WHEN run_day < DATE '2024-01-25' THEN 'STALE' WHEN e OR r THEN 'ALERT' WHEN s THEN 'DEGRADED' ELSE 'OK' END AS status FROM f")
def k4_run_status(spark: SparkSession, sf: str) -> DataFrame:
    return obs.run_status(obs.judge(obs.day_runs(m.table(spark, sf, "events"))), "2024-01-26")


@query(f"""WITH s AS (SELECT {DAY} AS batch_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS running, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
    SELECT batch_id, CASE WHEN failed > 70 THEN 'FAILED' WHEN running > 70 THEN 'RUNNING' WHEN users < 130 THEN 'EMPTY' ELSE 'SUCCESS' END AS outcome FROM s""")
def k1_batch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e = m.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("batch_id"))
    s = e.agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "signup").alias("running"), F.count_distinct("user_id").alias("users"))
    return s.select("batch_id", F.when(F.col("failed") > 70, "FAILED").when(F.col("running") > 70, "RUNNING").when(F.col("users") < 130, "EMPTY").otherwise("SUCCESS").alias("outcome"))


@query("""WITH n AS (SELECT event_type AS relation, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1) SELECT relation, before, after FROM n WHERE after < before * 0.99""")
def k7_row_count_drop(spark: SparkSession, sf: str) -> DataFrame:
    e, t = m.table(spark, sf, "events"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    count = lambda df: df.groupBy(F.col("event_type").alias("relation")).agg(F.count("*").alias("n_rows"))
    return obs.row_count_drop(count(e.filter(F.col("ts") < t)), count(e.filter(F.col("ts") >= t)))


@query("SELECT event_type AS domain, date_diff('second', max(ts), TIMESTAMP '2024-02-01') AS lag_seconds FROM events GROUP BY 1")
def k10_lag_by_domain_from_map(spark: SparkSession, sf: str) -> DataFrame:
    """The report's map of lags taken apart again, a row for each domain."""
    lags = obs.domain_lag(m.table(spark, sf, "events"), "event_type", "ts", "2024-02-01 00:00:00")
    report = lags.agg(F.map_from_entries(F.collect_list(F.struct("domain", "lag_seconds"))).alias("lags"))
    return report.select(F.explode("lags").alias("domain", "lag_seconds"))


@query("SELECT max(o_orderdate) < TIMESTAMP '2001-07-31' AS is_stale, date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02') AS lag_seconds FROM orders")
def k11_data_lag(spark: SparkSession, sf: str) -> DataFrame:
    return obs.data_lag(m.table(spark, sf, "orders"), "o_orderdate", "2001-08-02 00:00:00", 2 * 86400)


# --- dashboards over reports ----------------------------------------------------------------
@query(f"WITH {ORDERS}, f AS (SELECT *, min(order_date_key) OVER (PARTITION BY customer_id) AS k FROM orders_m) SELECT order_date_key, count(DISTINCT customer_id) AS n_customers FROM f WHERE order_date_key = k GROUP BY 1")
def m7_new_customers_daily(spark: SparkSession, sf: str) -> DataFrame:
    from .marts import d5_customer_activity_daily

    return d5_customer_activity_daily(spark, sf).filter("new_customers > 0").select("order_date_key", F.col("new_customers").alias("n_customers"))


@query(f"""WITH {VERSIONS}, s AS (SELECT *, lag(state) OVER (PARTITION BY customer_id ORDER BY updated_at) AS before FROM versions) SELECT sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END)::BIGINT AS started, count(*) FILTER (state = 'error') AS failed, count(*) AS n_changes FROM s""")
def m8_funnel_totals(spark: SparkSession, sf: str) -> DataFrame:
    from .marts import d7_state_funnel_daily

    return d7_state_funnel_daily(spark, sf).agg(F.sum("started").alias("started"), F.sum("failed").alias("failed"), F.sum("n_changes").alias("n_changes"))


@query(f"WITH {RUNS}, c AS (SELECT unnest([CASE WHEN e THEN 'dbt_errors' END, CASE WHEN r THEN 'row_count_drop' END, CASE WHEN s THEN 'run_slow' END]) AS code, run_day FROM f) SELECT CAST(strftime(run_day, '%Y%m%d') AS INTEGER) AS run_id, code FROM c WHERE code IS NOT NULL")
def m15_verdict_codes(spark: SparkSession, sf: str) -> DataFrame:
    text = obs.judge(obs.day_runs(m.table(spark, sf, "events"))).select("run_id", F.array_join("failures", ",").alias("codes")).filter("codes <> ''")
    return text.select("run_id", F.explode(F.split("codes", ",")).alias("code"))


@query("WITH l AS (SELECT event_type AS domain, date_diff('second', max(ts), TIMESTAMP '2024-02-01') AS lag_seconds FROM events GROUP BY 1) SELECT domain, 'lag' AS kind, lag_seconds AS seconds FROM l UNION ALL SELECT domain, 'threshold', 172800 FROM l")
def m16_lag_and_threshold(spark: SparkSession, sf: str) -> DataFrame:
    lags = obs.domain_lag(m.table(spark, sf, "events"), "event_type", "ts", "2024-02-01 00:00:00").withColumn("threshold", F.lit(172800).cast("long"))
    return lags.select("domain", F.expr("stack(2, 'lag', lag_seconds, 'threshold', threshold) AS (kind, seconds)"))


@query("SELECT event_type AS domain, strftime(max(ts), '%Y-%m-%d') AS as_of, count(*) > 2000 AS is_held FROM events GROUP BY 1")
def m13_domain_publish_state(spark: SparkSession, sf: str) -> DataFrame:
    e = m.table(spark, sf, "events")
    lags = obs.domain_lag(e, "event_type", "ts", "2024-02-01 00:00:00")
    held = e.groupBy(F.col("event_type").alias("domain")).agg((F.count("*") > 2000).alias("is_held"))
    return lags.join(held, "domain", "left").select("domain", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "is_held")


@query(f"WITH {ORDERS}, t AS (SELECT customer_id, count(*) FILTER (order_status = 'DELIVERED') AS n FROM orders_m GROUP BY 1) SELECT CASE WHEN n >= 15 THEN 'GOLD' WHEN n >= 5 THEN 'SILVER' ELSE 'BRONZE' END AS tier, count(*) AS n_customers FROM t GROUP BY 1")
def m6_tier_customers(spark: SparkSession, sf: str) -> DataFrame:
    from .marts import d6_tier_performance

    return d6_tier_performance(spark, sf).select("tier", "n_customers")


# --- serving ----------------------------------------------------------------------------------
@query("SELECT 'dim_seller' AS relation, count(*) AS n_rows, true AS is_fresh FROM supplier UNION ALL SELECT 'fct_order', count(*), true FROM orders")
def a33_serving_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Published tables copied to a serving folder with a manifest; fresh while it names the live publish."""
    from .publish import Publisher, export_serving

    pub = Publisher(spark, scratch(spark), {"fct_order": "orders", "dim_seller": "shared", "int_orders": "orders"})
    pub.publish({"fct_order": m.fct_order(spark, sf), "dim_seller": m.dim_seller(spark, sf), "int_orders": m.stg_orders(spark, sf)}, [])
    manifest = export_serving(spark, pub, scratch(spark), ("dim_", "fct_", "rpt_"))
    rows = manifest.select("publish_id", F.explode("row_counts").alias("relation", "n_rows"))
    return rows.select("relation", "n_rows", (F.col("publish_id") == F.lit(pub.live())).alias("is_fresh"))


@query("SELECT 'fct_payment' AS relation FROM events GROUP BY 1")
def l4_mismatched_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of two builds that differ, by hash."""
    pay = m.fct_payment(spark, sf)
    a = hashing.relation_hashes({"fct_payment": pay, "dim_seller": m.dim_seller(spark, sf)})
    b = hashing.relation_hashes({"fct_payment": pay.filter("payment_date_key < 20240120"), "dim_seller": m.dim_seller(spark, sf).repartition(3)})
    return hashing.mismatched_relations(a, b).select("relation")


@query("SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_key, count(*) AS n_reports FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT 20990101, 1")
def a35_record_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reports upserted by run id: a repeated run replaces its report, a new one is added."""
    e = m.table(spark, sf, "events").filter("event_type = 'error'").groupBy(date_key(F.col("ts")).alias("day_key")).agg(F.count("*").alias("n_reports"))
    old = e.withColumn("n_reports", F.col("n_reports") - F.col("day_key") % 2)
    again = e.filter("day_key % 2 = 1").unionByName(e.limit(1).select(F.lit(20990101).alias("day_key"), F.lit(1).cast("long").alias("n_reports")))
    return ledger.upsert(old, again, ["day_key"])


@query("SELECT user_id AS customer_id, count(*) AS n_payments, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100 AS payment_total FROM events WHERE event_type = 'purchase' GROUP BY 1")
def d2_payment_totals(spark: SparkSession, sf: str) -> DataFrame:
    return m.purchases(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n_payments"), F.sum("payment_value").cast(D).alias("payment_total"))


@query(f"SELECT count(DISTINCT {DAY}) FILTER (ts < TIMESTAMP '2024-01-21') AS n_committed, count(DISTINCT {DAY}) FILTER (ts >= TIMESTAMP '2024-01-21') AS n_uncommitted FROM events")
def d20_object_counts(spark: SparkSession, sf: str) -> DataFrame:
    written = committed_days(bronze_by_day(spark, sf))
    there = written.filter("batch_id < '20240121'").select("batch_id", F.lit(True).alias("_c"))
    joined = written.select("batch_id").join(there, "batch_id", "left")
    return joined.agg(F.count_if("_c").alias("n_committed"), F.count_if(F.col("_c").isNull()).alias("n_uncommitted"))


@query(f"SELECT {DAY} AS batch_id, count(*) AS n_rows, 6 AS n_source_columns, 5 AS n_technical_columns FROM events GROUP BY 1")
def a27_inspect_bronze(spark: SparkSession, sf: str) -> DataFrame:
    bronze = bronze_by_day(spark, sf)
    technical = [c for c in bronze.columns if c.startswith("_")]
    source = [c for c in bronze.columns if not c.startswith("_") and c != "batch_id"]
    return bronze.groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.lit(len(source)).alias("n_source_columns"), F.lit(len(technical)).alias("n_technical_columns"))


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) > 68 AS held, max(ts) AS last FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS pos FROM d)
    SELECT event_type AS domain, strftime(max(last), '%Y-%m-%d %H:%M:%S.%f') AS as_of, bool_or(held AND pos = 1) AS is_held, coalesce(min(CASE WHEN NOT held THEN pos END) - 1, count(*)) AS consecutive_holds FROM r GROUP BY 1""")
def a34_serving_domain_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per domain its last event, whether the newest publish held it, and for how many publishes."""
    e = m.table(spark, sf, "events")
    publishes = e.groupBy(F.col("event_type").alias("domain"), F.to_date("ts").alias("day")).agg((F.count("*") > 68).alias("held"))
    holds = obs.consecutive_holds(publishes, "domain", "day", "held")
    last = obs.domain_lag(e, "event_type", "ts", "2024-02-01 00:00:00")
    return last.join(holds, "domain", "full_outer").select("domain", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("as_of"), (F.col("consecutive_holds") > 0).alias("is_held"), "consecutive_holds")


@query(f"""WITH {VERSIONS} SELECT count(*) AS n_violations FROM events e JOIN versions v ON v.customer_id = e.user_id AND e.ts >= v.effective_from AND (v.valid_to IS NULL OR e.ts < v.valid_to) WHERE event_type = 'purchase' AND v.batch_id > '20240115'""")
def l8_boundary_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A held dimension beside newer facts: the references across the boundary are checked again."""
    from ..operators.history import scd2_fold, with_surrogate_key

    held = scd2_fold(m.observations(spark, sf).filter("_batch_id <= '20240115'"), "customer_id", "attribute_hash", "updated_at")
    held = with_surrogate_key(held, "customer_id", "attribute_hash", "customer_key")
    broken = quality.relationships(m.fct_payment(spark, sf), "customer_key", held, "customer_key")
    return broken.agg(F.count("*").alias("n_violations"))

