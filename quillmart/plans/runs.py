"""Queries of run reports: every rule of their verdict, outcomes of batches, holds and publish state.

A run is a quarter of a day of events. What a report would gather from the host
(task states, file counts, leases) derives from the run's counts of events here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import model as m
from . import observability as obs
from .registry import query

DOMAINS = ["orders", "shared", "subscriptions"]

RUN = "strftime(ts, '%Y%m%d') || '-' || CAST(hour(ts) // 6 AS VARCHAR)"
REPORT = f"""runs AS (SELECT {RUN} AS run_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1),
    reports AS (SELECT *, lag(n) OVER (ORDER BY run_id) AS n0, lag(p) OVER (ORDER BY run_id) AS p0 FROM runs),
    judged AS (SELECT run_id, p % 5 = 0 AS held_orders, c % 5 = 0 AS held_subscriptions, concat_ws(',',
        CASE WHEN e % 4 = 0 THEN 'TASK_NOT_SUCCESS:extract' END, CASE WHEN s % 5 = 0 THEN 'TASK_NOT_SUCCESS:build' END, CASE WHEN p % 6 = 0 THEN 'PUBLISH_FAILED' END, CASE WHEN c % 7 = 0 THEN 'SERVING_EXPORT_FAILED' END,
        CASE WHEN v % 9 = 0 THEN 'REPOINT_SKIPPED' END, CASE WHEN e % 11 = 0 THEN 'NOT_FRESH' END, CASE WHEN s % 8 = 0 THEN 'DBT_TEST_WARN' END, CASE WHEN p % 5 = 0 THEN 'PUBLISH_PARTIAL:orders' END, CASE WHEN c % 5 = 0 THEN 'PUBLISH_PARTIAL:subscriptions' END,
        CASE WHEN v * 100 > 1800 THEN 'DATA_STALE' END, CASE WHEN c * 100 > 1800 THEN 'DATA_STALE:orders' END, CASE WHEN p * 100 > 1800 THEN 'DATA_STALE:subscriptions' END,
        CASE WHEN e % 13 <> 0 AND n < n0 * (1 - 0.01) THEN 'ROW_COUNT_DROP:fct_order' END, CASE WHEN e % 13 <> 0 AND p < p0 * (1 - 0.01) THEN 'ROW_COUNT_DROP:fct_payment' END,
        CASE WHEN v % 10 = 0 THEN 'EXPORTS_COUNT_3' END, CASE WHEN s % 6 > 3 THEN 'FAILED_BUILDS_OVER_RETENTION' END, CASE WHEN c % 12 = 0 THEN 'BUILD_DIR_NOT_EMPTY' END, CASE WHEN v % 14 = 0 THEN 'LEASE_HELD' END,
        CASE WHEN n * 8 >= 600 THEN 'SLOW_RUN' END, CASE WHEN p % 15 = 0 THEN 'PROBE_ERROR:dag' END) AS failures FROM reports)"""
ALERT = "failures LIKE '%PUBLISH_PARTIAL:%' OR failures LIKE '%DATA_STALE:%' OR failures LIKE '%PUBLISH_FAILED%' OR failures LIKE '%ROW_COUNT_DROP:%'"


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report for each run, with the row counts of the run before."""
    of = lambda k: F.count_if(F.col("event_type") == k).cast("long")
    run = F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), F.floor(F.hour("ts") / 6).cast("string"))
    r = m.table(spark, sf, "events").groupBy(run.alias("run_id")).agg(F.count("*").alias("n"), of("error").alias("e"), of("signup").alias("s"), of("click").alias("c"), of("view").alias("v"), of("purchase").alias("p"))
    each = lambda k, x: F.col(k) % x == 0
    named = lambda *xs: F.filter(F.array(*[F.when(c, name) for name, c in xs]), lambda x: x.isNotNull())
    task = lambda name, bad: F.struct(F.lit(name).alias("task_id"), F.when(bad, "failed").otherwise("success").alias("state"))
    sizes = F.create_map(F.lit("fct_order"), F.col("n"), F.lit("fct_payment"), F.col("p"))
    # A row for each run.
    before = F.lag(sizes).over(W.orderBy("run_id"))
    return r.select(
        "run_id", F.array(task("extract", each("e", 4)), task("build", each("s", 5))).alias("tasks"), F.when(each("p", 6), "FAILED").otherwise("PUBLISHED").alias("publish_status"),
        F.when(each("c", 7), "FAILED").otherwise("SUCCESS").alias("serving_export_status"), F.when(each("v", 9), "SKIPPED").otherwise("SUCCESS").alias("repoint_status"), (~each("e", 11)).alias("fresh"),
        each("s", 8).cast("int").alias("tests_warned"), named(("orders", each("p", 5)), ("subscriptions", each("c", 5))).alias("held_domains"), (F.col("v") * 100).alias("data_lag_s"),
        F.create_map(F.lit("orders"), F.col("c") * 100, F.lit("subscriptions"), F.col("p") * 100).alias("domain_lag_s"), before.alias("previous_row_counts"), sizes.alias("row_counts"), each("e", 13).alias("full_refresh"),
        (F.lit(2) + each("v", 10).cast("int")).alias("exports_count"), (F.col("s") % 6).alias("failed_builds_count"), (~each("c", 12)).alias("warehouse_build_empty"), F.lit(True).alias("serving_build_empty"),
        named(("events", each("v", 14))).alias("held_leases"), (F.col("n") * 8).alias("elapsed_s"), named(("dag", each("p", 15))).alias("probe_errors"),
    )


LIMITS = obs.Limits(stale_after_s=1800, exports=2, failed_builds=3)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    r = reports(spark, sf)
    return r.withColumn("failures", obs.report_failures(LIMITS))


@query(f"WITH {REPORT} SELECT run_id, failures, failures = '' AS ok FROM judged")
def k5_judge_reports(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("run_id", F.array_join("failures", ",").alias("failures"), (F.size("failures") == 0).alias("ok"))


@query(f"WITH {REPORT} SELECT run_id, CASE WHEN run_id < '20240125' THEN 'STALE' WHEN {ALERT} THEN 'ALERT' WHEN failures <> '' THEN 'DEGRADED' ELSE 'OK' END AS status FROM judged")
def k4_report_status(spark: SparkSession, sf: str) -> DataFrame:
    r = judged(spark, sf).withColumn("run_day", F.to_date(F.substring("run_id", 1, 8), "yyyyMMdd"))
    alert = F.size(obs.alerts(F.col("failures"))) > 0
    age = F.datediff(F.lit("2024-01-26").cast("date"), "run_day")
    return r.select("run_id", F.when(age > 1, "STALE").when(alert, "ALERT").when(F.size("failures") > 0, "DEGRADED").otherwise("OK").alias("status"))


@query(f"WITH {REPORT}, c AS (SELECT unnest(string_split(failures, ',')) AS code FROM judged WHERE failures <> '') SELECT code, count(*) AS n_runs FROM c GROUP BY 1")
def d17_failure_codes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each code was given, first gathered as one JSON object and read back from it."""
    counts = judged(spark, sf).select(F.explode("failures").alias("code")).groupBy("code").agg(F.count("*").alias("n_runs"))
    one = counts.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n_runs"))))).alias("histogram"))
    return one.select(F.explode(F.from_json("histogram", "map<string, bigint>")).alias("code", "n_runs"))


@query(f"""WITH {REPORT}, d AS (SELECT run_id, 'orders' AS domain, held_orders AS held FROM judged UNION ALL SELECT run_id, 'subscriptions', held_subscriptions FROM judged),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY run_id DESC) AS pos FROM d)
    SELECT domain, coalesce(min(CASE WHEN NOT held THEN pos END) - 1, count(*)) AS consecutive_holds, max(CASE WHEN NOT held THEN run_id END) AS last_clean FROM r GROUP BY 1""")
def k9_holds_and_last_clean(spark: SparkSession, sf: str) -> DataFrame:
    """For how many of the newest publishes a domain was held, and the last one that was clean."""
    r = judged(spark, sf).select("run_id", F.explode(F.array(F.lit("orders"), F.lit("subscriptions"))).alias("domain"), "held_domains")
    publishes = r.select("run_id", "domain", F.array_contains("held_domains", F.col("domain")).alias("held"))
    last = publishes.groupBy("domain").agg(F.max(F.when(~F.col("held"), F.col("run_id"))).alias("last_clean"))
    return obs.consecutive_holds(publishes, "domain", "run_id", "held").join(last, "domain")


@query(f"""WITH {REPORT}, last AS (SELECT * FROM judged WHERE failures NOT LIKE '%PUBLISH_FAILED%' ORDER BY run_id DESC LIMIT 1)
    SELECT domain, CASE WHEN domain = 'orders' AND held_orders OR domain = 'subscriptions' AND held_subscriptions THEN 'held' ELSE 'published' END AS state, run_id FROM (VALUES ('orders'), ('shared'), ('subscriptions')) t(domain) CROSS JOIN last""")
def m13_publish_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each expected domain's state in the last publish that took place."""
    done = judged(spark, sf).filter("publish_status = 'PUBLISHED'")
    last = done.agg(F.max_by(F.struct("run_id", "held_domains"), "run_id").alias("r")).select("r.*")
    expected = last.select(F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("domain"), "run_id", "held_domains")
    return expected.select("domain", F.when(F.array_contains("held_domains", F.col("domain")), "held").otherwise("published").alias("state"), "run_id")


@query("""WITH a AS (SELECT strftime(ts, '%Y%m%d') AS batch_id, event_type AS source_table, user_id % 3 AS attempt, count(*) AS n, count(*) FILTER (value > 10) AS rows_loaded FROM events GROUP BY ALL),
    t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY batch_id, source_table ORDER BY attempt DESC) = 1),
    b AS (SELECT batch_id, bool_or(n % 17 = 0) AS failed, bool_or(n % 13 = 0) AS running, (SELECT count(*) FROM a x WHERE x.batch_id = t.batch_id) > 14 AS rerun, sum(rows_loaded) AS n_rows FROM t GROUP BY batch_id)
    SELECT batch_id, CASE WHEN failed THEN 'FAILED' WHEN running THEN 'RUNNING' WHEN rerun THEN 'RERUN' WHEN n_rows = 0 THEN 'EMPTY' ELSE 'SUCCESS' END AS outcome, max(batch_id) FILTER (NOT failed AND NOT running) OVER (ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS last_published FROM b""")
def k1_outcome_and_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Each batch's outcome from the last attempt of each of its tables, with the last batch that could be published by then."""
    a = m.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("batch_id"), F.col("event_type").alias("source_table"), (F.col("user_id") % 3).alias("attempt"))
    a = a.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("rows_loaded"))
    runs = a.select("batch_id", "source_table", "attempt", F.when(F.col("n") % 17 == 0, "FAILED").when(F.col("n") % 13 == 0, "RUNNING").otherwise("SUCCESS").alias("status"), (F.col("n") % 17 == 0).alias("is_failed"), (F.col("n") % 13 == 0).alias("is_running"), "rows_loaded")
    b = obs.batch_outcomes(runs, reruns_from=15)
    # A row for each batch.
    done = F.when(F.col("outcome").isin("SUCCESS", "RERUN", "EMPTY"), F.col("batch_id"))
    return b.select("batch_id", "outcome", F.max(done).over(W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)).alias("last_published"))


@query("""WITH c AS (SELECT o_orderpriority AS check_name, count(*) FILTER (o_orderkey % 4 = 0) > 0 AS failed FROM orders GROUP BY 1),
    map AS (SELECT * FROM (VALUES ('1-URGENT', 'orders'), ('2-HIGH', 'orders'), ('2-HIGH', 'subscriptions'), ('3-MEDIUM', 'subscriptions'), ('4-NOT SPECIFIED', 'shared')) t(check_name, domain))
    SELECT check_name, CASE WHEN count(DISTINCT domain) = 1 THEN max(domain) END AS owner FROM c LEFT JOIN map USING (check_name) WHERE failed GROUP BY 1""")
def l6_attribute_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Failing checks with the one domain that owns the models they read, null where there are several or none."""
    results = m.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("check_name")).agg((F.count_if(F.col("o_orderkey") % 4 == 0) > 0).alias("failed"))
    reads = spark.createDataFrame([("1-URGENT", "orders"), ("2-HIGH", "orders"), ("2-HIGH", "subscriptions"), ("3-MEDIUM", "subscriptions"), ("4-NOT SPECIFIED", "shared")], "check_name string, domain string")
    return obs.attribute_failures(results.filter("failed").select("check_name"), reads)
