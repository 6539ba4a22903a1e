"""Queries of rules over what other queries build: staging against its source, metrics against facts, gates, seeds, contracts, serving status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import date_key, standardize
from ..operators import quality
from ..sources import ledger, scans
from ..sources.contracts import EVENTS
from . import contracts as k
from . import marts
from . import model as m
from . import observability as obs
from . import runs
from .ingest import DAY, bronze_by_day, scratch, stamp
from .registry import ITEMS, ORDERS, VERSIONS, query

D = "double"


# --- staging against its source -----------------------------------------------------
def staged_and_raw(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, DataFrame, dict[str, str]]]:
    """For each staging function: its rows, the source's rows, both with a key `k`, and which column is which of the source."""
    t = lambda name: m.table(spark, sf, name)
    events, line_key = t("events"), F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = m.stg_order_items(spark, sf).withColumn("k", F.concat_ws("-", "order_id", "order_item_id"))
    # The raw lines repeat their keys; of a key the staged record's own fields say which is meant.
    raw_lines = t("lineitem").select(F.concat_ws("-", line_key, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")).alias("k"), "l_partkey", "l_suppkey").distinct()
    lines = lines.withColumn("k", F.concat_ws("-", "k", "product_id", "seller_id", "shipped_at"))
    orders, raw_orders = m.stg_orders(spark, sf), t("orders").withColumn("status", standardize(F.col("o_orderstatus"), m.STATUS))
    pay = k.order_payments(spark, sf).filter("payment_sequence = 1")
    raw_pay = raw_orders.withColumn("pay", standardize(F.col("o_orderstatus"), {"F": "COMPLETED", "P": "FAILED", "O": "PENDING"}))
    deals = k.contract_observations(spark, sf)
    raw_deals = events.select(F.col("event_id").alias("k"), standardize(F.col("event_type"), k.CONTRACT_STATUS).alias("s"), (F.col("value") < 20).alias("r"), "user_id")
    return {
        "stg_orders": (orders.withColumn("k", F.col("order_id")), raw_orders.withColumnRenamed("o_orderkey", "k"), {"order_status": "status", "customer_id": "o_custkey", "purchase_at": "o_orderdate", "priority": "o_orderpriority"}),
        "stg_order_items": (lines, raw_lines, {"product_id": "l_partkey", "seller_id": "l_suppkey"}),
        "stg_order_payments": (pay.withColumn("k", F.col("order_id")), raw_pay.withColumnRenamed("o_orderkey", "k"), {"payment_status": "pay", "purchase_at": "o_orderdate"}),
        "dim_product": (m.dim_product(spark, sf).withColumn("k", F.col("product_id")), t("part").withColumn("cat", F.nullif("p_type", F.lit("ECONOMY"))).withColumnRenamed("p_partkey", "k"), {"brand": "p_brand", "category_name": "cat"}),
        "dim_seller": (m.dim_seller(spark, sf).withColumn("k", F.col("seller_id")), t("supplier").withColumnRenamed("s_suppkey", "k"), {"seller_name": "s_name", "nation_key": "s_nationkey"}),
        "dim_customer_geo": (m.dim_customer_geo(spark, sf).withColumn("k", F.col("customer_id")), t("customer").withColumnRenamed("c_custkey", "k"), {"segment": "c_mktsegment"}),
        "stg_states": (m.observations(spark, sf).withColumn("k", F.col("_ingested_at")), events.withColumnRenamed("event_id", "k"), {"state": "event_type", "customer_id": "user_id", "updated_at": "ts"}),
        "stg_purchases": (m.purchases(spark, sf).withColumn("k", F.col("payment_id")), events.withColumnRenamed("event_id", "k"), {"payment_at": "ts", "customer_id": "user_id"}),
        "stg_contracts": (deals.withColumn("k", F.col("_ingested_at")), raw_deals, {"status": "s", "renews": "r", "customer_id": "user_id"}),
    }


@query(f"""WITH {ITEMS}, {k.CONTRACT_OBS}, n AS (
    SELECT 'stg_orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'stg_order_items', count(*) FROM items_m UNION ALL SELECT 'stg_order_payments', count(*) FROM orders UNION ALL SELECT 'dim_product', count(*) FROM part
    UNION ALL SELECT 'dim_seller', count(*) FROM supplier UNION ALL SELECT 'dim_customer_geo', count(*) FROM customer UNION ALL SELECT 'stg_states', count(*) FROM (SELECT DISTINCT user_id, ts, event_type FROM events WHERE event_type <> 'purchase')
    UNION ALL SELECT 'stg_purchases', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'stg_contracts', count(*) FROM c_obs)
    SELECT t AS model, n AS n_rows, 0 AS n_wrong, true AS finds_spoilt FROM n""")
def i20_staging_models(spark: SparkSession, sf: str) -> DataFrame:
    """Each staging function's columns against the source's: none is wrong, and a spoilt one is found in as many rows as it was spoilt in."""
    out = []
    for name, (staged, raw, pairs) in staged_and_raw(spark, sf).items():
        first = next(iter(pairs))
        hit = F.crc32(F.col("k").cast("string").cast("binary")) % 7 == 0
        both = staged.withColumn("spoilt", F.when(~hit, F.col(first)))
        wrong = quality.mapping_differences(both, raw, "k", pairs | {"spoilt": pairs[first]})
        counts = wrong.agg(F.sum(F.when(F.col("column_name") != "spoilt", F.col("n_rows"))).cast("int").alias("n_wrong"), F.sum(F.when(F.col("column_name") == "spoilt", F.col("n_rows"))).alias("found"))
        there = staged.agg(F.count("*").alias("n_rows"), F.count_if(hit & F.col(first).isNotNull()).alias("hit"))
        # One row each.
        out.append(there.crossJoin(counts).select(F.lit(name).alias("model"), "n_rows", "n_wrong", (F.col("found") == F.col("hit")).alias("finds_spoilt")))
    return reduce(DataFrame.unionByName, out)


# --- metric relations against facts ---------------------------------------------------
@query(f"""WITH {ORDERS}, {marts.TIERS}, p AS ({marts.PAYMENT_SQL})
    SELECT 'activity' AS metric, order_date_key::VARCHAR AS part FROM orders_m WHERE order_id % 997 = 0 GROUP BY 2
    UNION ALL SELECT 'tier', tier FROM orders_m JOIN tiers USING (customer_id) WHERE order_id % 997 = 0 GROUP BY 2
    UNION ALL SELECT 'payments', payment_date_key || '/' || coalesce(state_at_payment, 'unknown') FROM p WHERE payment_id % 97 = 0 GROUP BY 2""")
def i21_metric_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of three metric relations that differ from what their fact gives, once some rows are taken from the fact."""
    fact = m.fct_order(spark, sf).filter("order_id % 997 <> 0")
    tiers = m.tiers(m.stg_orders(spark, sf)).select("customer_id", "tier")
    pay = m.fct_payment(spark, sf).filter("payment_id % 97 <> 0").withColumn("state_at_payment", F.coalesce("state_at_payment", F.lit("unknown")))
    total = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").cast(D).alias("v"))
    activity = marts.d5_customer_activity_daily(spark, sf).select("order_date_key", F.col("n_orders").alias("n"))
    tier = marts.d6_tier_performance(spark, sf).select("tier", F.col("n_orders").alias("n"), F.col("gmv").alias("v"))
    paid = marts.d8_payment_outcomes_daily(spark, sf).select("payment_date_key", "state_at_payment", F.col("n_payments").alias("n"), F.col("payment_value").alias("v"))
    found = {
        "activity": quality.reconcile(activity, fact.groupBy("order_date_key").agg(F.count("*").alias("n")), ["order_date_key"], ["n"]).select(F.col("order_date_key").cast("string").alias("part")),
        "tier": quality.reconcile(tier, total(fact.join(tiers, "customer_id").withColumn("v", F.col("order_value")), ["tier"]), ["tier"], ["n", "v"]).select(F.col("tier").alias("part")),
        "payments": quality.reconcile(paid, total(pay.withColumn("v", F.col("payment_value")), ["payment_date_key", "state_at_payment"]), ["payment_date_key", "state_at_payment"], ["n", "v"]).select(F.concat_ws("/", "payment_date_key", "state_at_payment").alias("part")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("metric"), "part") for name, df in found.items()])


# --- gates ------------------------------------------------------------------------------
#: Where a forced failure stands: its domain, and the decisions it must lead to for orders, shared and subscriptions.
CANARIES = {
    "shared": ("shared", "publish,block,publish"), "orders": ("orders", "hold,publish,publish"), "subscriptions": ("subscriptions", "publish,publish,hold"),
    "dim_subscription": ("subscriptions", "publish,publish,hold"), "rpt_orders": ("orders", "hold,publish,publish"),
}


@query("SELECT canary, decisions, changed FROM (VALUES " + ", ".join(f"('{c}', '{d}', '{'' if s == 'shared' else ','.join(sorted(t for t, o in (('dim_product', 'shared'), ('fct_order', 'orders'), ('fct_payment', 'subscriptions')) if o != s))}')" for c, (s, d) in CANARIES.items()) + ") t(canary, decisions, changed), (SELECT count(*) FROM orders)")
def i25_five_canaries(spark: SparkSession, sf: str) -> DataFrame:
    """Five checks forced to fail, one a publish of the same build: what each domain's gate decides, and which relations the publish changes."""
    from .publish import Publisher, domain_decisions

    tables = {"fct_order": m.stg_orders(spark, sf), "fct_payment": m.purchases(spark, sf), "dim_product": m.dim_product(spark, sf)}
    domains = {"fct_order": "orders", "fct_payment": "subscriptions", "dim_product": "shared"}
    rows, build = [], Publisher(spark, scratch(spark), domains).build(tables)
    for canary, (domain, _) in CANARIES.items():
        pub = Publisher(spark, scratch(spark), domains)
        first = next(iter(tables.values()))
        checks = [quality.Check(f"{d}_rows", d, lambda: first.filter("order_id IS NULL")) for d in sorted(set(domains.values()))] + [quality.Check(f"{canary}_canary", domain, lambda: first.limit(1))]
        decided = {r.domain: r.decision for r in domain_decisions(quality.run_checks(checks)).collect()}
        rows.append((canary, ",".join(decided[d] for d in sorted(decided)), ",".join(sorted(pub.publish(build, checks)))))
    return spark.createDataFrame(rows, "canary string, decisions string, changed string")


# --- seeds ----------------------------------------------------------------------------------
@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN o_custkey || '.5' WHEN o_orderkey % 5 = 0 THEN o_custkey || '.0' ELSE o_custkey::VARCHAR END AS qty,
        CASE WHEN o_orderkey % 13 = 0 THEN 'much' WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) || '.125' ELSE (o_orderkey % 100)::VARCHAR END AS price, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'soon' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+09:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS seen FROM orders)
    SELECT concat_ws(',', CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN 'qty' END, CASE WHEN k % 13 = 0 THEN 'price' END, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN 'seen' END) AS errors, count(*) AS n_rows,
        coalesce(sum(CASE WHEN k % 11 <> 0 AND k % 7 <> 0 THEN CAST(CAST(qty AS DOUBLE) AS BIGINT) END), 0)::BIGINT AS qty,
        coalesce(sum(CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 3 = 0 THEN (k % 100) * 100 + 12 ELSE (k % 100) * 100 END END), 0)::BIGINT AS cents,
        coalesce(sum(CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN epoch(strptime(substr(seen, 1, 19), '%Y-%m-%d %H:%M:%S')) - CASE WHEN k % 2 = 0 THEN 32400 ELSE 0 END END), 0)::BIGINT AS seconds FROM o GROUP BY 1""")
def b15_strict_types(spark: SparkSession, sf: str) -> DataFrame:
    """Seed columns as text: whole numbers only, money to two decimals, timestamps in UTC; errors name their columns."""
    n = F.col("o_orderkey")
    off = lambda x: n % x == 0
    cust, cents, at = F.col("o_custkey").cast("string"), (n % 100).cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    raw = m.table(spark, sf, "orders").select(
        F.when(off(11), "n/a").when(off(7), F.concat(cust, F.lit(".5"))).when(off(5), F.concat(cust, F.lit(".0"))).otherwise(cust).alias("qty"),
        F.when(off(13), "much").when(off(3), F.concat(cents, F.lit(".125"))).otherwise(cents).alias("price"),
        F.when(off(17), F.lit(None)).when(off(19), "soon").when(off(2), F.concat(at, F.lit("+09:00"))).otherwise(at).alias("seen"),
    )
    kinds = {"qty": "integer", "price": "money", "seen": "timestamp"}
    typed = raw.select(F.array_join(quality.strict_errors(raw, kinds, ("seen",)), ",").alias("errors"), *[quality.strict(F.col(c), kind).alias(c) for c, kind in kinds.items()])
    total = lambda c: F.coalesce(F.sum(c).cast("bigint"), F.lit(0))
    return typed.groupBy("errors").agg(F.count("*").alias("n_rows"), total(F.col("qty")).alias("qty"), total(F.col("price") * 100).alias("cents"), total(F.unix_seconds("seen")).alias("seconds"))


@query(f"""WITH {ORDERS}, {ITEMS} SELECT 'order' AS kind, order_id, 0 AS part, strftime(purchase_at, '%Y-%m-%d') AS created_at, order_status AS status FROM orders_m
    UNION ALL SELECT 'item', order_id, order_item_id, strftime(purchase_at, '%Y-%m-%d'), NULL FROM items_m LEFT JOIN orders_m USING (order_id)
    UNION ALL SELECT 'payment', order_id, 1, strftime(purchase_at, '%Y-%m-%d'), CASE order_status WHEN 'DELIVERED' THEN 'COMPLETED' WHEN 'PROCESSING' THEN 'FAILED' ELSE 'PENDING' END FROM orders_m
    UNION ALL SELECT 'payment', order_id, 2, strftime(purchase_at, '%Y-%m-%d'), CASE order_status WHEN 'DELIVERED' THEN 'COMPLETED' WHEN 'PROCESSING' THEN 'FAILED' ELSE 'PENDING' END FROM orders_m WHERE order_id % 3 = 0""")
def b16_seed_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, lines and payments with the creation that lines and payments take from their order's purchase, and payments' status from the order's."""
    orders = m.stg_orders(spark, sf).select("order_id", "order_status", F.date_format("purchase_at", "yyyy-MM-dd").alias("created_at"))
    lines = m.stg_order_items(spark, sf).select("order_id", F.col("order_item_id").alias("part")).join(orders.drop("order_status"), "order_id", "left")
    pay = k.order_payments(spark, sf).select("order_id", F.col("payment_sequence").alias("part"), F.col("payment_status").alias("status")).join(orders.drop("order_status"), "order_id", "left")
    own = orders.select("order_id", F.lit(0).alias("part"), F.col("order_status").alias("status"), "created_at")
    kinds = {"order": own, "item": lines.withColumn("status", F.lit(None).cast("string")), "payment": pay}
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "order_id", F.col("part").cast("int").alias("part"), "created_at", "status") for kind, df in kinds.items()])


# --- contracts, inspection, checksums, serving ---------------------------------------------------
@query("""SELECT 'dim_date' AS relation, count(*) AS n_rows, '' AS differences FROM (SELECT unnest(generate_series(min(d)::DATE::TIMESTAMP, max(d)::DATE::TIMESTAMP, INTERVAL 1 DAY)) FROM (SELECT o_orderdate AS d FROM orders UNION ALL SELECT l_shipdate FROM lineitem))
    UNION ALL SELECT 'dim_product', count(*), 'brand: string instead of bigint;extra: not in the contract' FROM part""")
def i22_output_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Built relations against the names and types they are promised with; one breaks its promise."""
    days = {"date_key": "int", "date_day": "date", "year": "bigint", "quarter": "bigint", "month": "bigint", "day": "bigint", "day_of_week": "bigint"}
    products = {"product_id": "bigint", "category_name": "string", "brand": "bigint"}
    built = {"dim_date": (m.dim_date(spark, sf), days), "dim_product": (m.dim_product(spark, sf).withColumn("extra", F.lit(1)), products)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("relation"), "n_rows", F.lit(";".join(quality.contract_differences(df, c))).alias("differences")) for n, (df, c) in built.items()])


def inspect_batch(bronze: DataFrame, batch: str, sample: int) -> DataFrame:
    """What an operator looks at of one batch, as (section, name, value): manifest, schema and the first rows by cursor."""
    mine = bronze.filter(F.col("batch_id") == batch)
    man = ledger.batch_manifest(mine, EVENTS).select(F.lit("manifest").alias("section"), F.expr("stack(3, 'n_rows', CAST(n_rows AS string), 'schema_version', CAST(schema_version AS string), 'last_key', CAST(last_cursor.event_id AS string)) AS (name, value)"))
    schema = bronze.sparkSession.createDataFrame([("schema", f.name, f.dataType.simpleString()) for f in bronze.schema], "section string, name string, value string")
    first = mine.orderBy(*[F.col(c) for c in (EVENTS.cursor, *EVENTS.keys)]).limit(sample)
    rows = first.select(F.lit("sample").alias("section"), F.col("event_id").cast("string").alias("name"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("value"))
    return man.unionByName(schema).unionByName(rows)


@query(f"""WITH b AS (SELECT * FROM events WHERE {DAY} = '20240110')
    SELECT 'manifest' AS section, 'n_rows' AS name, count(*)::VARCHAR AS value FROM b UNION ALL SELECT 'manifest', 'schema_version', '3' FROM (SELECT count(*) FROM b) UNION ALL SELECT 'manifest', 'last_key', max_by(event_id, (ts, event_id))::VARCHAR FROM b
    UNION ALL SELECT 'schema', n, t FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('event_type', 'string'), ('value', 'double'), ('props', 'string'), ('_batch_id', 'string'), ('_run_id', 'string'), ('_ingested_at', 'timestamp'), ('_source_table', 'string'), ('_schema_version', 'int'), ('batch_id', 'string')) s(n, t)
    UNION ALL SELECT 'sample', event_id::VARCHAR, user_id || '|' || event_type FROM (SELECT * FROM b ORDER BY ts, event_id LIMIT 3)""")
def a27_inspect_batch(spark: SparkSession, sf: str) -> DataFrame:
    return inspect_batch(bronze_by_day(spark, sf), "20240110", 3)


@query("""WITH f AS (SELECT 'part=' || (c_custkey % 7) AS name, sha256(string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10)) AS h FROM customer GROUP BY c_custkey % 7)
    SELECT sha256(string_agg(name || ':' || h, chr(10) ORDER BY name)) AS dataset_sha256, count(*) AS n_files FROM f""")
def a2_file_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """customer as text in seven files; their checksums are of the bytes on storage."""
    path, part = scratch(spark), (F.col("c_custkey") % 7).alias("part")
    c = m.table(spark, sf, "customer").withColumn("part", part).repartition(7, "part").sortWithinPartitions("part", "c_custkey")
    c.select("part", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value")).write.partitionBy("part").text(path)
    return scans.combined_checksum(scans.dataset_checksum(spark, f"{path}/part=*/*.txt", F.element_at(F.split("path", "/"), -2)))


def serving_status(publishes: DataFrame, as_of: DataFrame) -> DataFrame:
    """domain, as_of, refreshed_at, is_held, consecutive_holds out of publish records (domain, run_id, published, held) and the last event of each domain.

    A publish that failed or was blocked counts for no domain; refreshed_at is the last
    one that took place and did not hold the domain.
    """
    done = publishes.filter("published")
    holds = obs.consecutive_holds(done, "domain", "run_id", "held")
    last = done.groupBy("domain").agg(F.max(F.when(~F.col("held"), F.col("run_id"))).alias("refreshed_at"), F.max_by("held", "run_id").alias("is_held"))
    return last.join(holds, "domain").join(as_of, "domain", "full_outer").select("domain", "as_of", "refreshed_at", "is_held", "consecutive_holds")


STATUS_SQL = f"""WITH {runs.REPORT}, d AS (SELECT run_id, 'orders' AS domain, held_orders AS held FROM judged WHERE failures NOT LIKE '%PUBLISH_FAILED%' UNION ALL SELECT run_id, 'subscriptions', held_subscriptions FROM judged WHERE failures NOT LIKE '%PUBLISH_FAILED%' UNION ALL SELECT run_id, 'shared', false FROM judged WHERE failures NOT LIKE '%PUBLISH_FAILED%'),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY run_id DESC) AS pos FROM d),
    a AS (SELECT CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'subscriptions' WHEN 'view' THEN 'shared' ELSE 'other' END AS domain, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS as_of, date_diff('second', max(ts), TIMESTAMP '2024-02-01') AS lag_seconds FROM events GROUP BY 1),
    s AS (SELECT domain, max(run_id) FILTER (NOT held) AS refreshed_at, bool_or(held AND pos = 1) AS is_held, coalesce(min(CASE WHEN NOT held THEN pos END) - 1, count(*))::BIGINT AS consecutive_holds FROM r GROUP BY 1)"""


def domain_status(spark: SparkSession, sf: str) -> DataFrame:
    r = runs.judged(spark, sf).select("run_id", F.explode(F.array(*[F.lit(d) for d in runs.DOMAINS])).alias("domain"), (F.col("publish_status") == "PUBLISHED").alias("published"), "held_domains")
    publishes = r.withColumn("held", F.array_contains("held_domains", F.col("domain")))
    domain: Column = F.lit("other")
    for event, name in (("purchase", "orders"), ("signup", "subscriptions"), ("view", "shared")):
        domain = F.when(F.col("event_type") == event, name).otherwise(domain)
    last = m.table(spark, sf, "events").groupBy(domain.alias("domain")).agg(F.max("ts").alias("as_of"))
    return serving_status(publishes, last)


@query(f"{STATUS_SQL} SELECT domain, as_of, refreshed_at, is_held, consecutive_holds FROM s FULL JOIN a USING (domain)")
def a34_domain_status(spark: SparkSession, sf: str) -> DataFrame:
    """Per domain its last event, its last publish that went through, whether the newest one held it, and for how many it has been held."""
    return domain_status(spark, sf).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"""{STATUS_SQL} SELECT domain, CASE WHEN refreshed_at IS NULL THEN 'NEVER_PUBLISHED' WHEN consecutive_holds >= 2 THEN 'HELD_AGAIN' WHEN is_held THEN 'HELD' WHEN lag_seconds > 1800 THEN 'STALE' ELSE 'OK' END AS status, lag_seconds FROM s FULL JOIN a USING (domain)""")
def k10_domain_view(spark: SparkSession, sf: str) -> DataFrame:
    """One word on each domain, from its publish records and the lag of its data."""
    s = domain_status(spark, sf)
    lag = F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("as_of").cast("timestamp"))
    status = F.when(F.col("refreshed_at").isNull(), "NEVER_PUBLISHED").when(F.col("consecutive_holds") >= 2, "HELD_AGAIN").when(F.col("is_held"), "HELD").when(lag > 1800, "STALE").otherwise("OK")
    return s.select("domain", status.alias("status"), lag.alias("lag_seconds"))
