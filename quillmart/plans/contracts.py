"""Queries of order payments and of subscription contracts.

Each order is paid in one or two parts that derive from it; each user has contracts
whose observations derive from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import attribute_hash, date_key
from ..operators import incremental, quality
from ..operators.history import as_of_join_by_window, dedupe_observations, scd2_fold, with_surrogate_key
from . import model as m
from .registry import ITEMS, ORDERS, VERSIONS, query

D = "double"
# The contract status that an event stands for here, and those of open contracts.
CONTRACT_STATUS = {"signup": "ACTIVE", "view": "ACTIVE", "click": "PAYMENT_FAILED", "error": "CANCEL_REQUESTED", "purchase": "ENDED"}
OPEN = ["ACTIVE", "PAYMENT_FAILED", "CANCEL_REQUESTED"]

PAYMENTS = f"""{ORDERS}, payments AS (
    SELECT order_id, s AS payment_sequence, customer_id, purchase_at, CASE order_status WHEN 'DELIVERED' THEN 'COMPLETED' WHEN 'PROCESSING' THEN 'FAILED' ELSE 'PENDING' END AS payment_status,
           CASE WHEN s = 2 THEN cents // 3 WHEN order_id % 3 = 0 THEN cents - cents // 3 ELSE cents END AS cents
    FROM orders_m, (VALUES (1), (2)) t(s) WHERE s = 1 OR order_id % 3 = 0)"""
CONTRACT_OBS = """c_seen AS (
    SELECT user_id * 2 + event_id % 2 AS contract_id, user_id AS customer_id, CASE event_type WHEN 'click' THEN 'PAYMENT_FAILED' WHEN 'error' THEN 'CANCEL_REQUESTED' WHEN 'purchase' THEN 'ENDED' ELSE 'ACTIVE' END AS status,
           value < 20 AS renews, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period_start, ts + INTERVAL 30 DAY AS billing_due_at, ts AS updated_at, event_id, strftime(ts, '%Y%m%d') AS batch_id FROM events),
c_hashed AS (SELECT *, md5('status:' || length(status) || ':' || status || '|renew:' || length(renews::VARCHAR) || ':' || renews::VARCHAR || '|period-start:' || length(period_start) || ':' || period_start) AS attribute_hash FROM c_seen),
c_obs AS (SELECT * FROM c_hashed QUALIFY row_number() OVER (PARTITION BY contract_id, updated_at, attribute_hash ORDER BY event_id DESC) = 1)"""
CONTRACTS = CONTRACT_OBS + """,
c_changed AS (SELECT * FROM c_obs WINDOW w AS (PARTITION BY contract_id ORDER BY updated_at) QUALIFY lag(attribute_hash) OVER w IS DISTINCT FROM attribute_hash),
contracts AS (SELECT *, row_number() OVER w AS version, CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '0001-01-01' ELSE updated_at END AS effective_from, lead(updated_at) OVER w AS valid_to, lead(updated_at) OVER w IS NULL AS is_current,
           md5(contract_id || '|' || strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') || '+00' || '|' || attribute_hash) AS contract_key FROM c_changed WINDOW w AS (PARTITION BY contract_id ORDER BY updated_at))"""


def order_payments(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each payment of an order: every third order is paid in two parts."""
    orders = m.stg_orders(spark, sf)
    cents = (F.col("order_value") * 100).cast("bigint")
    third = F.expr("CAST(order_value * 100 AS BIGINT) DIV 3")
    split = F.col("order_id") % 3 == 0
    parts = F.when(split, F.array(F.struct(F.lit(1).alias("payment_sequence"), (cents - third).alias("cents")), F.struct(F.lit(2).alias("payment_sequence"), third.alias("cents")))).otherwise(F.array(F.struct(F.lit(1).alias("payment_sequence"), cents.alias("cents"))))
    status = F.when(F.col("order_status") == "DELIVERED", "COMPLETED").when(F.col("order_status") == "PROCESSING", "FAILED").otherwise("PENDING")
    one = orders.select("order_id", "customer_id", "purchase_at", status.alias("payment_status"), F.explode(parts).alias("p"))
    value = (F.col("p.cents").cast("decimal(16,0)") * F.expr("0.01BD")).cast("decimal(14,2)")
    return one.select("order_id", F.col("p.payment_sequence").alias("payment_sequence"), "customer_id", "purchase_at", "payment_status", value.alias("payment_value"))


def orders_with_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer's version in force at the purchase."""
    return as_of_join_by_window(m.stg_orders(spark, sf), m.dim_customer_state(spark, sf), "customer_id", "purchase_at", ["customer_key"])


def fct_order_payment(spark: SparkSession, sf: str) -> DataFrame:
    """Payments of orders with the order's customer version and purchase day; a payment without an order keeps null keys."""
    orders = orders_with_customer(spark, sf).select("order_id", "customer_key", date_key(F.col("purchase_at")).alias("purchase_date_key"))
    pay = order_payments(spark, sf).select("order_id", "payment_sequence", "payment_status", "payment_value")
    return pay.join(orders, "order_id", "left").select("order_id", "payment_sequence", "customer_key", "purchase_date_key", "payment_status", "payment_value")


def contract_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of contracts. The hash leaves out billing_due_at, which lies ahead and moves on its own."""
    e = m.table(spark, sf, "events")
    status = F.lit(None).cast("string")
    for k, v in CONTRACT_STATUS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    seen = e.select(
        (F.col("user_id") * 2 + F.col("event_id") % 2).alias("contract_id"), F.col("user_id").alias("customer_id"), status.alias("status"), (F.col("value") < 20).alias("renews"),
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("period_start"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("billing_due_at"), F.col("ts").alias("updated_at"),
        F.col("event_id").alias("_ingested_at"), F.date_format("ts", "yyyyMMdd").alias("_batch_id"),
    )
    hashed = seen.withColumn("attribute_hash", attribute_hash({"status": F.col("status"), "renew": F.col("renews"), "period-start": F.col("period_start")}))
    return dedupe_observations(hashed, "contract_id")


def dim_contract(spark: SparkSession, sf: str) -> DataFrame:
    versions = scd2_fold(contract_observations(spark, sf), "contract_id", "attribute_hash", "updated_at")
    return with_surrogate_key(versions, "contract_id", "attribute_hash", "contract_key")


def paid_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as payments of contracts: one of a contract's cycle is its week, attempts count up within it."""
    pay = m.table(spark, sf, "events").filter("event_type = 'purchase'")
    return pay.select(F.col("event_id").alias("payment_id"), (F.col("user_id") * 2 + F.col("event_id") % 2).alias("contract_id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("payment_at"), m.money(F.col("value")).alias("payment_value"))


def fct_contract_payment(spark: SparkSession, sf: str) -> DataFrame:
    """Payments with the versions of both customer and contract that were in force; those without either go."""
    one = as_of_join_by_window(paid_contracts(spark, sf), m.dim_customer_state(spark, sf), "customer_id", "payment_at", ["customer_key", "state"]).filter("customer_key IS NOT NULL")
    return as_of_join_by_window(one, dim_contract(spark, sf), "contract_id", "payment_at", ["contract_key", "status"]).filter("contract_key IS NOT NULL")


# --- order payments ------------------------------------------------------------
@query(f"WITH {PAYMENTS} SELECT order_id, payment_sequence, payment_status, cents / 100.0::DOUBLE AS payment_value FROM payments")
def b1_stg_order_payments(spark: SparkSession, sf: str) -> DataFrame:
    return order_payments(spark, sf).select("order_id", "payment_sequence", "payment_status", F.col("payment_value").cast(D).alias("payment_value"))


@query(f"""WITH {PAYMENTS}, {VERSIONS} SELECT order_id, payment_sequence, v.customer_key, CAST(strftime(purchase_at, '%Y%m%d') AS INTEGER) AS purchase_date_key, payment_status, cents / 100.0::DOUBLE AS payment_value
    FROM payments p LEFT JOIN versions v ON v.customer_id = p.customer_id AND p.purchase_at >= v.effective_from AND (v.valid_to IS NULL OR p.purchase_at < v.valid_to)""")
def j13_fct_order_payment(spark: SparkSession, sf: str) -> DataFrame:
    return fct_order_payment(spark, sf).withColumn("payment_value", F.col("payment_value").cast(D))


@query(f"""WITH {PAYMENTS}, {ITEMS}, t AS (SELECT order_id, sum(cents + freight) AS gross FROM items_m GROUP BY 1), s AS (SELECT order_id, sum(cents) FILTER (payment_status <> 'FAILED') AS paid, count(*) AS n FROM payments GROUP BY 1)
    SELECT o.order_id, coalesce(gross, 0) / 100.0::DOUBLE AS gross_order_value, coalesce(paid, 0) / 100.0::DOUBLE AS payment_total, coalesce(n, 0) AS n_payments FROM orders_m o LEFT JOIN t USING (order_id) LEFT JOIN s USING (order_id)""")
def c5_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the totals of their lines and of their payments, each summed before it is joined."""
    pay = order_payments(spark, sf).groupBy("order_id").agg(F.sum(F.when(F.col("payment_status") != "FAILED", F.col("payment_value"))).alias("paid"), F.count("*").alias("n"))
    items = m.item_totals(m.stg_order_items(spark, sf)).select("order_id", (F.col("items_value") + F.col("freight_value")).alias("gross"))
    joined = m.stg_orders(spark, sf).select("order_id").join(items, "order_id", "left").join(pay, "order_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("order_id", zero("gross").cast(D).alias("gross_order_value"), zero("paid").cast(D).alias("payment_total"), zero("n").alias("n_payments"))


@query(f"""WITH {PAYMENTS}, {VERSIONS} SELECT 'date' AS what, count(*) AS n FROM payments WHERE order_id % 11 = 0 UNION ALL SELECT 'customer', count(*) FROM payments p LEFT JOIN versions v ON v.customer_id = p.customer_id AND v.version = 1 WHERE order_id % 13 = 0 AND v.customer_key IS NOT NULL
    UNION ALL SELECT 'status', count(*) FROM orders_m o JOIN lineitem l ON l.l_orderkey = o.order_id WHERE order_id % 17 = 0 AND order_status <> 'SHIPPED'""")
def i14_children_agree_with_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Payments' days and customers and lines' statuses against their orders', with some spoilt over the whole set."""
    orders = orders_with_customer(spark, sf).withColumn("purchase_date_key", date_key(F.col("purchase_at")))
    pay = fct_order_payment(spark, sf)
    off = lambda k: F.col("order_id") % k == 0
    spoilt = pay.withColumns({"purchase_date_key": F.col("purchase_date_key") + off(11).cast("int"), "customer_key": F.when(off(13), None).otherwise(F.col("customer_key"))})
    lines = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id")).join(orders.select("order_id", "order_status"), "order_id").withColumn("order_status", F.when(off(17), "SHIPPED").otherwise(F.col("order_status")))
    found = {"date": (spoilt, "purchase_date_key"), "customer": (spoilt, "customer_key"), "status": (lines, "order_status")}
    counts = None
    for what, (child, column) in found.items():
        parent = orders.select("order_id", F.col(column).alias("_parent"))
        bad = child.join(parent, "order_id").filter(~F.col(column).eqNullSafe(F.col("_parent"))).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        counts = bad if counts is None else counts.unionByName(bad)
    return counts


# --- contracts -----------------------------------------------------------------
@query(f"WITH {CONTRACT_OBS} SELECT contract_id, customer_id, status, renews, period_start, strftime(billing_due_at, '%Y-%m-%d %H:%M:%S.%f') AS billing_due_at, attribute_hash FROM c_obs")
def j2b_contract_observations(spark: SparkSession, sf: str) -> DataFrame:
    return contract_observations(spark, sf).select("contract_id", "customer_id", "status", "renews", "period_start", F.date_format("billing_due_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("billing_due_at"), "attribute_hash")


@query(f"""WITH {ORDERS}, o AS (SELECT *, count(*) FILTER (order_status = 'DELIVERED') OVER (PARTITION BY customer_id ORDER BY purchase_at, order_id) AS n FROM orders_m),
    t AS (SELECT customer_id, purchase_at, order_id, CASE WHEN n >= 15 THEN 'GOLD' WHEN n >= 5 THEN 'SILVER' ELSE 'BRONZE' END AS tier FROM o),
    u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY customer_id, purchase_at, tier ORDER BY order_id DESC) = 1), c AS (SELECT * FROM u WINDOW w AS (PARTITION BY customer_id ORDER BY purchase_at, order_id) QUALIFY lag(tier) OVER w IS DISTINCT FROM tier)
    SELECT customer_id, tier, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY purchase_at, order_id) AS INTEGER) AS version, strftime(purchase_at, '%Y-%m-%d') AS valid_from FROM c""")
def j2a_tier_history(spark: SparkSession, sf: str) -> DataFrame:
    """Tier observations, one after each order, folded into versions."""
    from pyspark.sql import Window as W

    along = W.partitionBy("customer_id").orderBy("purchase_at", "order_id")
    n = F.count_if(F.col("order_status") == "DELIVERED").over(along.rowsBetween(W.unboundedPreceding, 0))
    tier = F.when(n >= m.TIER_STEPS["GOLD"], "GOLD").when(n >= m.TIER_STEPS["SILVER"], "SILVER").otherwise("BRONZE")
    seen = m.stg_orders(spark, sf).select("customer_id", "order_id", "purchase_at", tier.alias("tier"))
    kept = dedupe_observations(seen, "customer_id", "purchase_at", "tier", ("order_id",))
    versions = scd2_fold(kept, "customer_id", "tier", "purchase_at", tiebreak=("order_id",))
    return versions.select("customer_id", "tier", "version", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query(f"""WITH {CONTRACTS} SELECT contract_id, customer_id, status, renews, period_start, CAST(version AS INTEGER) AS version, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, is_current, contract_key FROM contracts""")
def j3a_dim_contract(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return dim_contract(spark, sf).select("contract_id", "customer_id", "status", "renews", "period_start", "version", stamp("valid_from"), stamp("valid_to"), "is_current", "contract_key")


@query(f"WITH {CONTRACTS} SELECT customer_id, count(*) AS n_open FROM contracts WHERE is_current AND status IN ('ACTIVE', 'PAYMENT_FAILED', 'CANCEL_REQUESTED') GROUP BY 1 HAVING count(*) > 1")
def i12_one_open_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with more than one open contract."""
    open_ = dim_contract(spark, sf).filter(F.col("is_current") & F.col("status").isin(OPEN))
    return quality.unique(open_, "customer_id").withColumnRenamed("n_rows", "n_open")


BOTH = f"""WITH {VERSIONS}, {CONTRACTS}, paid AS (SELECT event_id AS payment_id, user_id * 2 + event_id % 2 AS contract_id, user_id AS customer_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'purchase'),
    both_ AS (SELECT p.*, v.customer_key, v.state, c.contract_key, c.status FROM paid p JOIN versions v ON v.customer_id = p.customer_id AND p.ts >= v.effective_from AND (v.valid_to IS NULL OR p.ts < v.valid_to)
    JOIN contracts c ON c.contract_id = p.contract_id AND p.ts >= c.effective_from AND (c.valid_to IS NULL OR p.ts < c.valid_to))"""


@query(f"{BOTH} SELECT payment_id, customer_key, contract_key, state AS state_at_payment, status AS status_at_payment, cents / 100.0::DOUBLE AS payment_value FROM both_")
def c4_two_histories(spark: SparkSession, sf: str) -> DataFrame:
    """Payments with the versions of two histories that were in force."""
    both = fct_contract_payment(spark, sf)
    return both.select("payment_id", "customer_key", "contract_key", F.col("state").alias("state_at_payment"), F.col("status").alias("status_at_payment"), F.col("payment_value").cast(D).alias("payment_value"))


@query(f"{BOTH} SELECT contract_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS cycle, count(*) AS n_attempts FROM both_ GROUP BY 1, 2 HAVING count(*) > 1")
def i7_cycle_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of a contract with more than one payment: composite keys that repeat."""
    pay = fct_contract_payment(spark, sf).withColumn("payment_at", F.col("payment_at")).select("contract_id", F.date_format(F.date_trunc("week", "payment_at"), "yyyy-MM-dd").alias("cycle"))
    return pay.groupBy("contract_id", "cycle").agg(F.count("*").alias("n_attempts")).filter("n_attempts > 1")


# --- keys that a run must compute anew --------------------------------------------
CAUSES = f"""WITH {ORDERS}, {VERSIONS},
    late AS (SELECT customer_id, min(updated_at) AS changed_from FROM obs WHERE batch_id > '20240120' GROUP BY 1),
    f AS (SELECT e.user_id, e.event_id, e.ts FROM events e WHERE event_type = 'purchase')"""


@query(f"""WITH {ORDERS}, src AS (SELECT order_id, customer_id, purchase_at, order_date_key FROM orders_m),
    causes AS (SELECT 'order' AS cause, order_id FROM src WHERE purchase_at > TIMESTAMP '2001-07-01'
        UNION ALL SELECT 'item', l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-09-01' UNION ALL SELECT 'payment', order_id FROM src WHERE order_id % 3 = 0 AND purchase_at > TIMESTAMP '2001-06-01'
        UNION ALL SELECT 'product', l_orderkey FROM lineitem WHERE l_partkey % 500 = 7 UNION ALL SELECT 'seller', l_orderkey FROM lineitem WHERE l_suppkey % 50 = 3
        UNION ALL SELECT 'customer', order_id FROM src JOIN (SELECT user_id, min(ts) AS t FROM events WHERE ts > TIMESTAMP '2024-01-29' GROUP BY 1) ON user_id = customer_id WHERE purchase_at > TIMESTAMP '2001-01-01')
    SELECT order_id, order_date_key, string_agg(DISTINCT cause, ',' ORDER BY cause) AS causes FROM causes JOIN src USING (order_id) GROUP BY 1, 2""")
def j7_six_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to compute anew and why: the order, its lines, its payments, and the customer, product or seller that they name."""
    orders = m.stg_orders(spark, sf).withColumn("order_date_key", date_key(F.col("purchase_at")))
    lines = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_shipdate", F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"))
    after = lambda c, t: F.col(c) > F.lit(f"{t} 00:00:00").cast("timestamp_ntz")
    products = m.dim_product(spark, sf).filter("product_id % 500 = 7").select("product_id")
    sellers = m.dim_seller(spark, sf).filter("seller_id % 50 = 3").select("seller_id")
    people = m.table(spark, sf, "events").filter(after("ts", "2024-01-29")).groupBy(F.col("user_id").alias("customer_id")).agg(F.min("ts").alias("changed_from"))
    causes = {
        "order": orders.filter(after("purchase_at", "2001-07-01")).select("order_id"),
        "item": lines.filter(after("l_shipdate", "2001-09-01")).select("order_id"),
        "payment": order_payments(spark, sf).filter((F.col("payment_sequence") == 2) & after("purchase_at", "2001-06-01")).select("order_id"),
        "product": incremental.affected_by_link(lines, products, "product_id", "order_id"),
        "seller": incremental.affected_by_link(lines, sellers, "seller_id", "order_id"),
        "customer": incremental.affected_by_link(orders.filter(after("purchase_at", "2001-01-01")), people, "customer_id", "order_id"),
    }
    every = incremental.record_affected(causes, "order_id", "run").select("affected_domain", F.col("entity_key").cast("bigint").alias("order_id"))
    named = every.groupBy("order_id").agg(F.array_join(F.sort_array(F.collect_set("affected_domain")), ",").alias("causes"))
    return orders.select("order_id", "order_date_key").join(named, "order_id")


@query(f"""WITH {CONTRACTS}, {VERSIONS}, paid AS (SELECT event_id AS payment_id, user_id * 2 + event_id % 2 AS contract_id, user_id AS customer_id, ts FROM events WHERE event_type = 'purchase')
    SELECT payment_id FROM paid WHERE strftime(ts, '%Y%m%d') > '20240125'
    UNION SELECT payment_id FROM paid JOIN (SELECT customer_id, min(updated_at) AS t FROM obs WHERE batch_id > '20240125' GROUP BY 1) USING (customer_id) WHERE ts >= t
    UNION SELECT payment_id FROM paid JOIN (SELECT contract_id, min(updated_at) AS t FROM c_obs WHERE batch_id > '20240125' GROUP BY 1) USING (contract_id) WHERE ts >= t""")
def j8_three_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Payments to compute anew: new ones, and those at or after a change of their customer or contract."""
    paid, lower = paid_contracts(spark, sf), "20240125"
    people = incremental.changed_keys(m.observations(spark, sf), "customer_id", "updated_at", "_batch_id", lower)
    deals = incremental.changed_keys(contract_observations(spark, sf), "contract_id", "updated_at", "_batch_id", lower)
    causes = {
        "payment": paid.filter(F.date_format("payment_at", "yyyyMMdd") > lower).select("payment_id"),
        "customer": incremental.affected_by_history(paid, people, "customer_id", "payment_at", "payment_id"),
        "contract": incremental.affected_by_history(paid, deals, "contract_id", "payment_at", "payment_id"),
    }
    return incremental.affected_units(causes, "payment_id")


@query(f"""WITH {CONTRACTS}, old AS (SELECT contract_id, contract_key FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY updated_at) AS r FROM c_obs WHERE event_id % 5 <> 0) JOIN c_obs USING (contract_id, updated_at, attribute_hash) JOIN LATERAL (SELECT md5(contract_id || '|' || strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') || '+00' || '|' || attribute_hash) AS contract_key) k ON true WHERE r = 1)
    SELECT contract_id FROM old JOIN contracts c USING (contract_id) WHERE c.version = 1 AND c.contract_key <> old.contract_key""")
def e10_first_version_moved(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts whose first version has another key once late observations are read."""
    seen = contract_observations(spark, sf)
    fold = lambda o: with_surrogate_key(scd2_fold(o, "contract_id", "attribute_hash", "updated_at"), "contract_id", "attribute_hash", "contract_key")
    return incremental.first_version_units(fold(seen.filter("_ingested_at % 5 <> 0")), fold(seen), "contract_id", "contract_key")
