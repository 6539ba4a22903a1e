"""Golden rows and invariants of the retail library."""

import uuid
from datetime import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmart.functions.scalars import date_key, money, ratio, surrogate_key, uuid5
from quillmart.operators import hashing, incremental, quality
from quillmart.operators.history import as_of_join, as_of_join_by_window, date_dimension, dedupe_observations, numbered, scd2_fold
from quillmart.sources import ledger, scans
from quillmart.sources.contracts import CONTRACTS, EVENTS, TableContract


def test_observation_dedup_keeps_the_last_reading(spark):
    rows = [
        ("a", "10-01", "h1", "10-02", "z", "older-ingestion"), ("a", "10-01", "h1", "10-03", "a", "older-batch"), ("a", "10-01", "h1", "10-03", "b", "winner"),
        ("a", "10-01", "h2", "10-02", "a", "other-hash"), ("a", "10-02", "h1", "10-03", "a", "other-time"), ("b", "10-01", "h1", "10-02", "a", "other-key"),
    ]
    df = spark.createDataFrame(rows, "key string, updated_at string, attribute_hash string, _ingested_at string, _batch_id string, payload string")
    out = dedupe_observations(df, "key")
    assert out.columns == df.columns
    assert {r.payload for r in out.collect()} == {"winner", "other-hash", "other-time", "other-key"}


def history(spark):
    rows = [("c1", dt(2026, 10, d), s) for d, s in ((1, "ACTIVE"), (2, "CHURNED"), (3, "ACTIVE"), (4, "ACTIVE"))] + [("c2", dt(2026, 10, 1), "CHURNED")]
    return scd2_fold(spark.createDataFrame(rows, "k string, at timestamp, h string"), "k", "h", "at")


def test_scd2_drops_repeats_and_chains_versions(spark):
    got = [(r.k, r.version, r.h, r.y, r.valid_to, r.is_current) for r in history(spark).withColumn("y", F.year("effective_from")).drop("effective_from").orderBy("k", "version").collect()]
    assert got == [
        ("c1", 1, "ACTIVE", 1600, dt(2026, 10, 2), False), ("c1", 2, "CHURNED", 2026, dt(2026, 10, 3), False), ("c1", 3, "ACTIVE", 2026, None, True), ("c2", 1, "CHURNED", 1600, None, True),
    ]
    v = history(spark)
    assert quality.exactly_one_current(v, "k").isEmpty() and quality.no_overlap(v, "k").isEmpty()


def test_as_of_joins_agree(spark):
    events = spark.createDataFrame([(i, k, dt(2026, 10, d, 12)) for i, (k, d) in enumerate([("c1", 1), ("c1", 2), ("c1", 9), ("c2", 5), ("none", 1)])], "id int, k string, t timestamp")
    v = history(spark)
    a = {(r.id, r.h) for r in as_of_join(events, v, "k", "t").collect()}
    b = {(r.id, r.h) for r in as_of_join_by_window(events, v, "k", "t", ["h", "version"]).collect()}
    assert a == b == {(0, "ACTIVE"), (1, "CHURNED"), (2, "ACTIVE"), (3, "CHURNED"), (4, None)}


ORDERS = CONTRACTS["orders"]


def orders(spark, *rows):
    base = {f.name: None for f in ORDERS.schema}
    full = []
    for r in rows:
        at = r.pop("at", dt(2026, 1, 1))
        full.append(tuple((base | {"customer_id": "c", "order_purchase_timestamp": at, "created_at": at, "updated_at": at} | r).values()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ORDERS.schema)
    return spark.createDataFrame(full, schema)


def test_validation_collects_every_code(spark):
    df = orders(
        spark, {"order_id": "o1", "order_status": "created"}, {"order_id": "o1", "order_status": "invalid", "at": dt(2026, 1, 1, 0, 0, 1)}, {"order_id": "o2", "order_status": "created"}, {"order_id": None, "order_status": "created"}
    )
    got = sorted((r.order_id or "", r.order_status, tuple(r._errors)) for r in quality.validate(df, ORDERS).collect())
    assert got == [("", "created", ("KEY_NULL", "REQUIRED_NULL")), ("o1", "created", ()), ("o1", "invalid", ("BATCH_DUPLICATE", "STATUS_DOMAIN_INVALID")), ("o2", "created", ())]


def test_an_invalid_first_row_still_claims_its_key(spark):
    df = orders(spark, {"order_id": "o1", "order_status": "bad"}, {"order_id": "o1", "order_status": "created", "at": dt(2026, 1, 2)})
    got = {r.order_status: tuple(r._errors) for r in quality.validate(df, ORDERS).collect()}
    assert got == {"bad": ("STATUS_DOMAIN_INVALID",), "created": ("BATCH_DUPLICATE",)}


def test_types_ranges_and_references(spark):
    c = TableContract("t", ("id",), "at", "id bigint NOT NULL, at timestamp NOT NULL, n int, ref string", minimums={"n": 0})
    df = spark.createDataFrame([("1", "2026-01-01", "x", "a"), ("2", "2026-01-01", "-1", "a"), ("3", "2026-01-01", "5", "gone"), ("4", "nonsense", None, None)], "id string, at string, n string, ref string")
    got = {r.id: tuple(r._errors) for r in quality.validate(df, c, {"ref": spark.createDataFrame([("a",), (None,)], "ref string")}).collect()}
    assert got == {"1": ("TYPE_MISMATCH",), "2": ("NUMERIC_RANGE_INVALID",), "3": ("BROKEN_REFERENCE",), "4": ("TYPE_MISMATCH",)}


@pytest.mark.parametrize("n, bad, passes", [(0, 0, True), (20, 0, True), (20, 1, True), (100, 5, True), (20, 2, False), (100, 6, False), (1, 1, False)])
def test_reject_gate_at_its_limit(spark, n, bad, passes):
    df = spark.range(n).select(F.when(F.col("id") < bad, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("_errors"))
    assert quality.reject_gate(df).first().passes is passes


def test_column_mismatch_stops_the_batch(spark):
    with pytest.raises(ValueError, match="SCHEMA_MISMATCH"):
        quality.validate(spark.range(1), ORDERS)


def test_delete_insert_replaces_whole_units(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "o int, v string")
    new = spark.createDataFrame([(1, "A")], "o int, v string")
    assert {tuple(r) for r in incremental.delete_insert(old, new, ["o"]).collect()} == {(1, "A"), (2, "c"), (3, "d")}
    affected = spark.createDataFrame([(1,), (3,)], "o int")
    assert {tuple(r) for r in incremental.delete_insert_strict(old, new, affected, ["o"]).collect()} == {(1, "A"), (2, "c")}


def test_hash_ignores_order_but_not_values_or_repeats(spark):
    h = lambda df: hashing.logical_hash(df).first().logical_hash
    a = spark.range(100).selectExpr("id", "CAST(id AS decimal(14,2)) v")
    assert h(a) == h(a.repartition(7).orderBy(F.desc("id")))
    assert h(a) != h(a.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")).cast("decimal(14,2)")))
    assert h(a) != h(a.unionByName(a.limit(1))) and h(a.unionByName(a)) != h(a.limit(0))


def test_uuid5_is_pythons(spark):
    got = spark.range(50).select(uuid5(quality.NAMESPACE, F.concat(F.lit("x:"), F.col("id").cast("string"))).alias("u"), "id").collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(quality.NAMESPACE), f"x:{r.id}")) for r in got)


def test_scalars(spark):
    r = spark.sql("SELECT 12.345D m, TIMESTAMP '2026-03-01 23:59:59' t, CAST(NULL AS double) n").select(money(F.col("m")).alias("m"), date_key(F.col("t")).alias("d"), ratio(F.lit(1), F.lit(0)).alias("z"), surrogate_key(F.lit(1), F.col("t"), F.lit("h")).alias("s")).first()
    assert (r.m, r.d, r.z, len(r.s)) == (Decimal("12.35"), 20260301, None, 32)


def test_date_dimension_spans_gaps_and_starts_weeks_on_sunday(spark):
    d = date_dimension(spark.createDataFrame([(dt(2026, 2, 27),), (dt(2026, 3, 2),)], "at timestamp"), "at").collect()
    assert [(r.date_key, r.day_of_week) for r in sorted(d)] == [(20260227, 5), (20260228, 6), (20260301, 0), (20260302, 1)]
    assert date_dimension(spark.createDataFrame([], "at timestamp"), "at").count() == 0


def test_numbered_is_gapless(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("k"))
    assert sorted((r.k, r.ordinal) for r in numbered(df, ["k"]).collect()) == [(i, i) for i in range(1000)]


def test_cursors_compare_by_time_then_key(spark):
    df = spark.createDataFrame([(i, dt(2026, 1, 1 + i // 3), 0, "view", 1.0, None) for i in range(9)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    got = [r.event_id for r in scans.incremental(df, EVENTS, (dt(2026, 1, 1), 1), (dt(2026, 1, 2), 4)).collect()]
    assert got == [2, 3, 4]
    assert [r.event_id for r in scans.keyset_page(df, EVENTS, (dt(2026, 1, 2), 4), 2).collect()] == [5, 6]


def test_replay_boundary_must_be_utc(spark):
    rows = [("events", f"o{i}", 3, f"b{i}", dt(2026, 9, d), 1, "h") for i, d in enumerate((9, 11))]
    led = spark.createDataFrame(rows, ledger.LEDGER)
    assert [r.batch_id for r in ledger.committed(led, "2026-09-10T00:00:00Z").collect()] == ["b0"]
    for bad in ("2026-09-10", "2026-09-10T00:00:00+09:00", "yesterday"):
        with pytest.raises(ValueError):
            ledger.committed(led, bad)
    with pytest.raises(ValueError):
        ledger.replay_evidence(led, "2026-09-10T00:00:00Z", False)
    assert ledger.unsupported_versions(led.withColumn("schema_version", F.lit(9))).count() == 1


def test_bronze_refuses_to_overwrite(spark, tmp_path):
    e = spark.createDataFrame([(1, dt(2026, 1, 1), 1, "view", 1.0, None)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    ledger.write_bronze(e, EVENTS, str(tmp_path / "b"), F.lit("b1"), "r", F.current_timestamp())
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        ledger.write_bronze(e, EVENTS, str(tmp_path / "b"), F.lit("b1"), "r", F.current_timestamp())


def test_publisher_blocks_and_holds(spark, tmp_path):
    from quillmart.plans.publish import Publisher

    pub = Publisher(spark, str(tmp_path / "pub"), {"a": "orders", "b": "subscriptions"})
    one, two = spark.range(1), spark.range(2)
    fail = lambda domain: [quality.Check("canary", domain, lambda: spark.range(1))]
    assert sorted(pub.publish({"a": one, "b": one}, [])) == ["a", "b"]
    assert pub.publish({"a": two, "b": two}, fail("shared")) == [] and pub.published()["a"].count() == 1
    assert pub.publish({"a": two, "b": two}, fail("subscriptions")) == ["a"] and pub.held() == ["b"]
    assert {n: df.count() for n, df in pub.published().items()} == {"a": 2, "b": 1}
    warn = [quality.Check("canary", "subscriptions", lambda: spark.range(1), "warn")]
    assert pub.publish({"a": two, "b": two}, warn) == ["b"]


def test_stream_hands_over_valid_and_rejected(spark, tmp_path):
    from quillmart.streaming.bronze import ingest_available

    c = TableContract("t", ("id",), "at", "id bigint NOT NULL, at timestamp NOT NULL, n int", minimums={"n": 0})
    spark.sql("SELECT id, TIMESTAMP '2026-01-01' at, CAST(id - 1 AS int) n FROM range(4)").write.parquet(str(tmp_path / "in"))
    seen = []
    q = ingest_available(spark, str(tmp_path / "in"), c, str(tmp_path / "ck"), lambda good, bad, n: seen.append((good.count(), bad.count())))
    q.awaitTermination()
    assert seen == [(3, 1)]


def test_output_contracts_and_typed_empty_relations(spark):
    days = date_dimension(spark.createDataFrame([(dt(2026, 2, 27),)], "at timestamp"), "at")
    want = {"date_key": "int", "date_day": "date", "year": "bigint", "quarter": "bigint", "month": "bigint", "day": "bigint", "day_of_week": "bigint"}
    assert quality.contract_differences(days, want) == []
    assert quality.contract_differences(days.drop("year").withColumn("x", F.lit(1)), want) == ["year: missing instead of bigint", "x: not in the contract"]
    for c in CONTRACTS.values():
        assert ledger.empty_relation(spark, c).schema == c.schema and not ledger.empty_relation(spark, c).head(1)


def test_ledger_takes_only_commits_that_follow(spark, tmp_path):
    from quillmart.sources.commits import Ledger

    row = spark.createDataFrame([("events", "o", 3, "b1", dt(2026, 9, 9), 1, "h")], ledger.LEDGER)
    led = Ledger(spark, str(tmp_path / "ledger"))
    assert led.watermark() == "" and led.rows().count() == 0
    assert led.commit(row, "", "b1") and not led.commit(row, "", "b2") and not led.commit(row, "b1", "b0")
    assert led.watermark() == "b1" and led.rows().count() == 1


def test_check_severities(spark):
    bad = lambda: spark.range(2)
    res = quality.run_checks([quality.Check("a", "x", bad), quality.Check("b", "x", bad, "warn"), quality.Check("c", "y", lambda: spark.range(0))])
    assert {(r.check_name, r.status, r.n_violations) for r in res.collect()} == {("a", "fail", 2), ("b", "warn", 2), ("c", "pass", 0)}
    assert tuple(quality.summarize_checks(res).first()) == (1, 1, 1, "a")


def test_checksum_files_grow_in_number_with_the_table(spark, monkeypatch):
    from quillmart.plans import ingest

    monkeypatch.setattr(ingest, "FILE_ROWS", 100)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert ingest.a2_dataset_checksum(spark, sf).first().n_files >= n / 100 > 4


# --- run reports -----------------------------------------------------------------------
REPORT = {
    "tasks": [("extract", "success"), ("audit", "not_terminal")], "publish_status": "PUBLISHED", "serving_export_status": "SUCCESS", "repoint_status": "SUCCESS", "fresh": True, "tests_warned": 0, "held_domains": [], "data_lag_s": 1800,
    "domain_lag_s": {"orders": 1800, "shared": None}, "previous_row_counts": {"fct_order": 100, "gone": 5}, "row_counts": {"fct_order": 99, "new": 1}, "full_refresh": False, "exports_count": 2, "failed_builds_count": 3,
    "warehouse_build_empty": True, "serving_build_empty": True, "held_leases": [], "elapsed_s": 599, "probe_errors": [],
}
REPORT_SCHEMA = (
    "tasks array<struct<task_id: string, state: string>>, publish_status string, serving_export_status string, repoint_status string, fresh boolean, tests_warned int, held_domains array<string>, data_lag_s bigint, domain_lag_s map<string, bigint>, "
    "previous_row_counts map<string, bigint>, row_counts map<string, bigint>, full_refresh boolean, exports_count int, failed_builds_count int, warehouse_build_empty boolean, serving_build_empty boolean, held_leases array<string>, elapsed_s int, probe_errors array<string>"
)


def test_each_rule_of_a_run_report(spark):
    from quillmart.plans.observability import Limits, alerts, report_failures

    cases = [
        ({}, []),
        ({"tasks": [("extract", "failed"), ("load", "skipped")]}, ["TASK_NOT_SUCCESS:extract", "TASK_NOT_SUCCESS:load"]),
        ({"publish_status": "FAILED"}, ["PUBLISH_FAILED"]), ({"publish_status": None}, ["PUBLISH_UNKNOWN"]), ({"serving_export_status": "ERROR"}, ["SERVING_EXPORT_FAILED"]), ({"repoint_status": None}, ["REPOINT_UNKNOWN"]),
        ({"fresh": False}, ["NOT_FRESH"]), ({"fresh": None}, []), ({"tests_warned": 2}, ["DBT_TEST_WARN"]), ({"held_domains": ["subscriptions", "orders"]}, ["PUBLISH_PARTIAL:subscriptions", "PUBLISH_PARTIAL:orders"]),
        ({"data_lag_s": 1801}, ["DATA_STALE"]), ({"domain_lag_s": {"b": 1801, "a": 9999, "c": 1}}, ["DATA_STALE:a", "DATA_STALE:b"]), ({"row_counts": {"fct_order": 98}}, ["ROW_COUNT_DROP:fct_order"]),
        ({"row_counts": {"fct_order": 98}, "full_refresh": True}, []), ({"previous_row_counts": None}, []), ({"exports_count": 4}, ["EXPORTS_COUNT_4"]), ({"failed_builds_count": 4}, ["FAILED_BUILDS_OVER_RETENTION"]),
        ({"warehouse_build_empty": False, "serving_build_empty": False}, ["BUILD_DIR_NOT_EMPTY"]), ({"held_leases": ["events"]}, ["LEASE_HELD"]), ({"elapsed_s": 600}, ["SLOW_RUN"]), ({"probe_errors": ["dag"]}, ["PROBE_ERROR:dag"]),
        ({"elapsed_s": 700, "publish_status": "PARTIAL", "held_domains": ["orders", "orders"]}, ["PUBLISH_PARTIAL", "PUBLISH_PARTIAL:orders", "SLOW_RUN"]),
    ]
    df = spark.createDataFrame([tuple((REPORT | c).values()) for c, _ in cases], REPORT_SCHEMA)
    got = df.select(report_failures(Limits(1800, 2, 3)).alias("f"), alerts(report_failures(Limits(1800, 2, 3))).alias("a")).collect()
    assert [r.f for r in got] == [want for _, want in cases]
    assert got[1].a == [] and got[9].a == ["PUBLISH_PARTIAL:subscriptions", "PUBLISH_PARTIAL:orders"] and got[2].a == ["PUBLISH_FAILED"] and got[10].a == []


def test_a_publish_audits_what_it_has_written(spark, tmp_path):
    from quillmart.plans.publish import Publisher

    seen = {}
    pub = Publisher(spark, str(tmp_path), {"t": "orders"})

    def checks(written):
        seen.update({n: df.inputFiles() for n, df in written.items()})
        return [quality.Check("none_negative", "orders", lambda: written["t"].filter("id < 0"))]

    assert pub.publish({"t": spark.range(3)}, checks) == ["t"] and str(tmp_path) in seen["t"][0]
    assert pub.publish({"t": spark.range(-1, 3)}, checks) == [] and pub.held() == ["t"] and pub.published()["t"].count() == 3


def test_rows_without_a_key_claim_nothing_and_are_dealt_apart(spark):
    c = TableContract("t", ("k",), "at", "k bigint NOT NULL, at timestamp NOT NULL")
    rows = [(None, dt(2026, 1, 1))] * 3 + [(1, dt(2026, 1, 2)), (1, dt(2026, 1, 1))]
    got = quality.validate(spark.createDataFrame(rows, "k bigint, at timestamp"), c)
    assert sorted((r.k is None, r["at"].day, r["_errors"]) for r in got.collect()) == [(False, 1, []), (False, 2, ["BATCH_DUPLICATE"])] + [(True, 1, ["KEY_NULL", "REQUIRED_NULL"])] * 3
    assert got.columns == ["k", "at", "_errors"]


@pytest.mark.parametrize("ends, n", [((0, 9), 3), ((5, 5), 4), ((-7, 100), 5), ((1, 1000), 1)])
def test_slices_part_a_table(spark, ends, n):
    df = spark.range(ends[0], ends[1] + 1).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k bigint"))
    parts = scans.slices(df, "k", n)
    assert len(parts) == n and sum(df.filter(p).count() for p in parts) == df.count()
    assert scans.slices(df.limit(0), "k", n) == ["1 = 1"]
