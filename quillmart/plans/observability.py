"""Run reports: verdicts, alerts, lags and holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import date_key

# The codes that alert, by prefix, and the limits of a run.
ALERT_PREFIXES = ["dbt_", "row_"]
MOST_ERRORS, MOST_ROWS, DROP = 60, 340, 0.99


# Codes that alert whatever else a report says.
ALERTS = ("PUBLISH_PARTIAL:", "DATA_STALE:", "PUBLISH_FAILED", "ROW_COUNT_DROP:")


@dataclass(frozen=True)
class Limits:
    """What a report is judged by."""

    stale_after_s: int
    exports: int
    failed_builds: int
    run_s: int = 600
    drop: float = 0.01


def report_failures(limits: Limits) -> Column:
    """The codes of a report, in rule order, each once; its columns are those of runs.reports. Missing values fail no rule but those that ask for success."""
    none = F.array().cast("array<string>")
    one = lambda code, c: F.when(c, F.array(F.lit(code) if isinstance(code, str) else code)).otherwise(none)
    each = lambda xs, code: F.transform(F.coalesce(xs, none), lambda x: F.concat(F.lit(code), x))
    col = F.col
    tasks = F.transform(F.filter("tasks", lambda t: ~t["state"].isin("success", "not_terminal")), lambda t: F.concat(F.lit("TASK_NOT_SUCCESS:"), t["task_id"]))
    late = F.filter(F.sort_array(F.map_keys("domain_lag_s")), lambda d: F.element_at("domain_lag_s", d) > limits.stale_after_s)
    both = F.sort_array(F.array_intersect(F.map_keys("previous_row_counts"), F.map_keys("row_counts")))
    fewer = F.when(~F.coalesce(col("full_refresh"), F.lit(False)), F.filter(both, lambda r: F.element_at("row_counts", r) < F.element_at("previous_row_counts", r) * (1 - limits.drop)))
    held = (F.size(F.coalesce("held_leases", none)) > 0)
    rules = [
        tasks,
        one(F.concat(F.lit("PUBLISH_"), F.coalesce("publish_status", F.lit("UNKNOWN"))), ~col("publish_status").eqNullSafe("PUBLISHED")),
        one("SERVING_EXPORT_FAILED", ~col("serving_export_status").eqNullSafe("SUCCESS")),
        one(F.concat(F.lit("REPOINT_"), F.coalesce("repoint_status", F.lit("UNKNOWN"))), ~col("repoint_status").eqNullSafe("SUCCESS")),
        one("NOT_FRESH", ~col("fresh")),
        one("DBT_TEST_WARN", col("tests_warned") > 0),
        each(col("held_domains"), "PUBLISH_PARTIAL:"),
        one("DATA_STALE", col("data_lag_s") > limits.stale_after_s),
        each(late, "DATA_STALE:"),
        each(fewer, "ROW_COUNT_DROP:"),
        one(F.concat(F.lit("EXPORTS_COUNT_"), col("exports_count").cast("string")), col("exports_count") != limits.exports),
        one("FAILED_BUILDS_OVER_RETENTION", col("failed_builds_count") > limits.failed_builds),
        one("BUILD_DIR_NOT_EMPTY", ~col("warehouse_build_empty") | ~col("serving_build_empty")),
        one("LEASE_HELD", held),
        one("SLOW_RUN", col("elapsed_s") >= limits.run_s),
        each(col("probe_errors"), "PROBE_ERROR:"),
    ]
    return F.array_distinct(F.concat(*[F.coalesce(r, none) for r in rules]))


def alerts(failures: Column) -> Column:
    return F.filter(failures, lambda x: F.exists(F.array(*[F.lit(a) for a in ALERTS]), lambda a: F.startswith(x, a)))


def batch_outcomes(runs: DataFrame, reruns_from: int) -> DataFrame:
    """batch_id, outcome: FAILED or RUNNING by the last attempt of any table, RERUN from so many attempts on, EMPTY without rows, else SUCCESS."""
    last = runs.groupBy("batch_id", "source_table").agg(F.max_by(F.struct("is_failed", "is_running", "rows_loaded"), "attempt").alias("r"), F.count("*").alias("n"))
    b = last.groupBy("batch_id").agg(F.bool_or("r.is_failed").alias("failed"), F.bool_or("r.is_running").alias("running"), F.sum("n").alias("attempts"), F.sum("r.rows_loaded").alias("n_rows"))
    return b.select("batch_id", F.when(F.col("failed"), "FAILED").when(F.col("running"), "RUNNING").when(F.col("attempts") >= reruns_from, "RERUN").when(F.col("n_rows") == 0, "EMPTY").otherwise("SUCCESS").alias("outcome"))


def attribute_failures(failed: DataFrame, reads: DataFrame) -> DataFrame:
    """check_name, owner: the one domain of the models that a failing check reads (check_name, domain), null for several or none."""
    joined = failed.join(reads, "check_name", "left").groupBy("check_name").agg(F.count_distinct("domain").alias("n"), F.max("domain").alias("d"))
    return joined.select("check_name", F.when(F.col("n") == 1, F.col("d")).alias("owner"))


def day_runs(events: DataFrame) -> DataFrame:
    """A run for each day: rows, errors, and the rows of the run before (a row for each day)."""
    d = events.groupBy(F.to_date("ts").alias("run_day")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return d.withColumn("rows_before", F.lag("n_rows").over(W.orderBy("run_day")))


def judge(runs: DataFrame) -> DataFrame:
    """run_id, failures (ordered, each once) and ok."""
    codes = F.array(
        F.when(F.col("n_errors") > MOST_ERRORS, "dbt_errors"),
        F.when(F.col("n_rows") < F.col("rows_before") * DROP, "row_count_drop"),
        F.when(F.col("n_rows") > MOST_ROWS, "run_slow"),
    )
    failures = F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))
    return runs.select(date_key(F.col("run_day")).alias("run_id"), "run_day", "n_rows", failures.alias("failures")).withColumn("ok", F.size("failures") == 0)


def domain_lag(events: DataFrame, domain: str, at: str, now: str) -> DataFrame:
    """domain, as_of (its last event) and lag_seconds, whole seconds between."""
    last = events.groupBy(F.col(domain).alias("domain")).agg(F.max(at).alias("as_of"))
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return last.withColumn("lag_seconds", seconds(F.lit(now).cast("timestamp_ntz")) - seconds(F.col("as_of")))


def consecutive_holds(publishes: DataFrame, domain: str, order: str, held: str) -> DataFrame:
    """domain, consecutive_holds: how many of the newest publishes held it."""
    placed = publishes.withColumn("_pos", F.row_number().over(W.partitionBy(domain).orderBy(F.desc(order))))
    first_clean = F.min(F.when(~F.col(held), F.col("_pos")))
    return placed.groupBy(F.col(domain).alias("domain")).agg(F.coalesce(first_clean - 1, F.count("*")).cast("long").alias("consecutive_holds"))


def run_status(judged: DataFrame, now_day: str) -> DataFrame:
    """run_id, status: STALE over a day old, ALERT with an alerting code, DEGRADED with another, else OK."""
    alert = F.exists("failures", lambda x: F.startswith(x, F.lit(ALERT_PREFIXES[0])) | F.startswith(x, F.lit(ALERT_PREFIXES[1])))
    age = F.datediff(F.lit(now_day).cast("date"), "run_day")
    return judged.select("run_id", F.when(age > 1, "STALE").when(alert, "ALERT").when(~F.col("ok"), "DEGRADED").otherwise("OK").alias("status"))


def row_count_drop(before: DataFrame, after: DataFrame, share: float = DROP) -> DataFrame:
    """relation, before, after where a publish has fewer than this share of the rows before."""
    a = after.select("relation", F.col("n_rows").alias("after"))
    joined = before.select("relation", F.col("n_rows").alias("before")).join(a, "relation", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return joined.filter(F.col("after") < F.col("before") * share)


def data_lag(df: DataFrame, at: str, now: str, threshold_seconds: int) -> DataFrame:
    """lag_seconds from the last `at` to now, is_stale beyond the threshold."""
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("_last").cast("timestamp"))
    return df.agg(F.max(at).alias("_last")).select((seconds > threshold_seconds).alias("is_stale"), seconds.alias("lag_seconds"))
