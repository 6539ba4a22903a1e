"""Queries of the marts, metrics and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import date_key, ratio
from ..operators.history import as_of_join, as_of_join_by_window, numbered
from . import model as m
from .registry import ITEMS, ORDERS, VERSIONS, query

D = "double"


def kpis(orders: DataFrame) -> list:
    value = F.sum("order_value")
    return [value.cast(D).alias("gmv"), F.count("*").alias("n_orders"), ratio(value, F.count("*")).alias("aov")]


@query(f"WITH {ORDERS} SELECT order_id, customer_id, order_status, order_date_key, cents / 100.0::DOUBLE AS order_value, priority FROM orders_m")
def b1_stg_orders(spark: SparkSession, sf: str) -> DataFrame:
    return m.stg_orders(spark, sf).select("order_id", "customer_id", "order_status", date_key(F.col("purchase_at")).alias("order_date_key"), F.col("order_value").cast(D).alias("order_value"), "priority")


@query(f"WITH {ITEMS} SELECT order_id, order_item_id, product_id, seller_id, cents / 100.0::DOUBLE AS price, freight / 100.0::DOUBLE AS freight_value FROM items_m")
def j1_current_order_items(spark: SparkSession, sf: str) -> DataFrame:
    return m.stg_order_items(spark, sf).select("order_id", "order_item_id", "product_id", "seller_id", F.col("price").cast(D).alias("price"), F.col("freight_value").cast(D).alias("freight_value"))


@query(f"WITH {ITEMS} SELECT order_id, sum(cents)::DOUBLE / 100 AS items_value, sum(freight)::DOUBLE / 100 AS freight_value, count(*) AS n_items FROM items_m GROUP BY 1")
def d1_order_item_totals(spark: SparkSession, sf: str) -> DataFrame:
    return m.item_totals(m.stg_order_items(spark, sf)).select("order_id", F.col("items_value").cast(D).alias("items_value"), F.col("freight_value").cast(D).alias("freight_value"), "n_items")


@query(f"""WITH {ORDERS}, {ITEMS}, t AS (SELECT order_id, sum(cents) AS c, sum(freight) AS f, count(*) AS n, max(shipped_at) AS d FROM items_m GROUP BY 1)
    SELECT order_id, customer_id, order_status, order_date_key, cents / 100.0::DOUBLE AS order_value, coalesce(c, 0)::DOUBLE / 100 AS items_value, coalesce(f, 0)::DOUBLE / 100 AS freight_value,
           coalesce(n, 0) AS n_items, CAST(date_diff('day', purchase_at, d) AS INTEGER) AS days_to_delivery, d > purchase_at + INTERVAL 90 DAY AS is_late
    FROM orders_m LEFT JOIN t USING (order_id)""")
def j11_fct_order(spark: SparkSession, sf: str) -> DataFrame:
    return m.fct_order(spark, sf).drop("purchase_at").withColumns({c: F.col(c).cast(D) for c in ("order_value", "items_value", "freight_value")})


@query(f"""WITH {ORDERS}, {ITEMS} SELECT i.order_id, order_item_id, product_id, seller_id, o.order_status, o.customer_id, o.order_date_key, (i.cents + freight)::DOUBLE / 100 AS line_gross
    FROM items_m i LEFT JOIN orders_m o USING (order_id)""")
def j12_fct_order_item(spark: SparkSession, sf: str) -> DataFrame:
    return m.fct_order_item(spark, sf).select("order_id", "order_item_id", "product_id", "seller_id", "order_status", "customer_id", "order_date_key", F.col("line_gross").cast(D).alias("line_gross"))


@query("SELECT p_partkey AS product_id, nullif(p_type, 'ECONOMY') AS category_name, p_brand AS brand FROM part")
def b14_dim_product(spark: SparkSession, sf: str) -> DataFrame:
    return m.dim_product(spark, sf)


@query("SELECT s_suppkey AS seller_id, s_name AS seller_name, s_nationkey AS nation_key FROM supplier")
def b14_dim_seller(spark: SparkSession, sf: str) -> DataFrame:
    return m.dim_seller(spark, sf)


@query("""SELECT user_id AS customer_id, event_type AS state, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS observed_at, md5('state:' || length(event_type) || ':' || event_type) AS attribute_hash FROM events
    WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts, event_type ORDER BY event_id DESC) = 1""")
def j2_observations(spark: SparkSession, sf: str) -> DataFrame:
    return m.observations(spark, sf).select("customer_id", "state", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_at"), "attribute_hash")


@query(f"""WITH {VERSIONS} SELECT customer_id, state, CAST(version AS INTEGER) AS version, strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to,
    is_current, version = 1 AS is_first, customer_key FROM versions""")
def j3_dim_customer_state(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return m.dim_customer_state(spark, sf).select("customer_id", "state", "version", stamp("valid_from"), stamp("valid_to"), "is_current", (F.year("effective_from") == 1600).alias("is_first"), "customer_key")


PAYMENT_SQL = f"""WITH {VERSIONS} SELECT event_id AS payment_id, user_id AS customer_id, v.customer_key, v.state AS state_at_payment, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS payment_date_key,
    CAST(round(value * 100) AS BIGINT) / 100.0::DOUBLE AS payment_value
    FROM events e LEFT JOIN versions v ON v.customer_id = e.user_id AND e.ts >= v.effective_from AND (v.valid_to IS NULL OR e.ts < v.valid_to) WHERE event_type = 'purchase'"""


@query(PAYMENT_SQL)
def j14_fct_payment(spark: SparkSession, sf: str) -> DataFrame:
    return m.fct_payment(spark, sf).drop("_batch_id").withColumn("payment_value", F.col("payment_value").cast(D))


@query(PAYMENT_SQL)
def j4b_as_of_join_by_window(spark: SparkSession, sf: str) -> DataFrame:
    j = as_of_join_by_window(m.purchases(spark, sf), m.dim_customer_state(spark, sf), "customer_id", "payment_at", ["customer_key", "state"])
    return j.select("payment_id", "customer_id", "customer_key", F.col("state").alias("state_at_payment"), date_key(F.col("payment_at")).alias("payment_date_key"), F.col("payment_value").cast(D).alias("payment_value"))


@query(f"""WITH {VERSIONS}, geo AS (SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT event_id AS payment_id, v.state AS state_at_payment, g.n_name AS customer_state FROM events e
    JOIN versions v ON v.customer_id = e.user_id AND e.ts >= v.effective_from AND (v.valid_to IS NULL OR e.ts < v.valid_to) JOIN geo g ON g.c_custkey = e.user_id WHERE event_type = 'purchase'""")
def c4_double_as_of_inner_join(spark: SparkSession, sf: str) -> DataFrame:
    versions = m.dim_customer_state(spark, sf).select("customer_id", "state", "effective_from", "valid_to")
    geo = m.dim_customer_geo(spark, sf).select("customer_id", "customer_state", F.lit("1600-01-01").cast("timestamp_ntz").alias("effective_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    one = as_of_join(m.purchases(spark, sf), versions, "customer_id", "payment_at", "inner").drop("effective_from", "valid_to")
    return as_of_join(one, geo, "customer_id", "payment_at", "inner").select("payment_id", F.col("state").alias("state_at_payment"), "customer_state")


@query("""WITH d AS (SELECT o_orderdate AS d FROM orders UNION ALL SELECT l_shipdate FROM lineitem), b AS (SELECT min(d)::DATE AS lo, max(d)::DATE AS hi FROM d),
    s AS (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date_day FROM b)
    SELECT CAST(strftime(date_day, '%Y%m%d') AS INTEGER) AS date_key, date_day, year(date_day) AS year, quarter(date_day) AS quarter, month(date_day) AS month, day(date_day) AS day, dayofweek(date_day) AS day_of_week FROM s""")
def j5_dim_date(spark: SparkSession, sf: str) -> DataFrame:
    return m.dim_date(spark, sf)


# --- metrics ----------------------------------------------------------------
@query(f"""WITH {ORDERS}, f AS (SELECT *, min(order_date_key) OVER (PARTITION BY customer_id) AS first_key FROM orders_m)
    SELECT order_date_key, count(DISTINCT CASE WHEN order_date_key = first_key THEN customer_id END) AS new_customers, count(DISTINCT CASE WHEN order_date_key > first_key THEN customer_id END) AS repeat_customers,
           count(*) AS n_orders, sum(CASE WHEN order_date_key = first_key THEN cents ELSE 0 END)::DOUBLE / 100 AS new_gmv FROM f GROUP BY 1""")
def d5_customer_activity_daily(spark: SparkSession, sf: str) -> DataFrame:
    o = m.stg_orders(spark, sf).withColumn("order_date_key", date_key(F.col("purchase_at")))
    first = F.col("order_date_key") == F.min("order_date_key").over(W.partitionBy("customer_id"))
    f = o.withColumn("is_new", first)
    # Distinct over a flag as a plain two-level aggregate: no row is expanded.
    by_customer = f.groupBy("order_date_key", "customer_id", "is_new").agg(F.count("*").alias("n"), F.sum("order_value").alias("v"))
    return by_customer.groupBy("order_date_key").agg(
        F.count_if("is_new").alias("new_customers"), F.count_if(~F.col("is_new")).alias("repeat_customers"), F.sum("n").alias("n_orders"), F.coalesce(F.sum(F.when(F.col("is_new"), F.col("v"))), F.lit(0)).cast(D).alias("new_gmv")
    )


TIERS = "t AS (SELECT customer_id, count(*) FILTER (order_status = 'DELIVERED') AS n_delivered FROM orders_m GROUP BY 1), tiers AS (SELECT *, CASE WHEN n_delivered >= 15 THEN 'GOLD' WHEN n_delivered >= 5 THEN 'SILVER' ELSE 'BRONZE' END AS tier FROM t)"


@query(f"WITH {ORDERS}, {TIERS} SELECT customer_id, n_delivered, tier FROM tiers")
def d11_membership_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return m.tiers(m.stg_orders(spark, sf))


@query(f"""WITH {ORDERS}, {TIERS} SELECT tier, count(DISTINCT customer_id) AS n_customers, count(*) AS n_orders, sum(cents)::DOUBLE / 100 AS gmv, count(*) FILTER (order_status = 'DELIVERED') AS delivered_orders,
    sum(cents) FILTER (order_status = 'DELIVERED')::DOUBLE / 100 AS delivered_gmv, (sum(cents) FILTER (order_status = 'DELIVERED')::DOUBLE / 100) / nullif(count(*) FILTER (order_status = 'DELIVERED'), 0) AS delivered_aov
    FROM orders_m JOIN tiers USING (customer_id) GROUP BY 1""")
def d6_tier_performance(spark: SparkSession, sf: str) -> DataFrame:
    o = m.stg_orders(spark, sf)
    done = F.col("order_status") == "DELIVERED"
    per = o.groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("order_value").alias("v"), F.count_if(done).alias("dn"), F.sum(F.when(done, F.col("order_value"))).alias("dv"))
    tier = F.when(F.col("dn") >= 15, "GOLD").when(F.col("dn") >= 5, "SILVER").otherwise("BRONZE")
    return per.groupBy(tier.alias("tier")).agg(
        F.count("*").alias("n_customers"), F.sum("n").alias("n_orders"), F.sum("v").cast(D).alias("gmv"), F.sum("dn").alias("delivered_orders"), F.sum("dv").cast(D).alias("delivered_gmv"), ratio(F.sum("dv"), F.sum("dn")).alias("delivered_aov")
    )


@query(f"""WITH {VERSIONS}, s AS (SELECT *, lag(state) OVER (PARTITION BY customer_id ORDER BY updated_at) AS before FROM versions)
    SELECT CAST(strftime(updated_at, '%Y%m%d') AS INTEGER) AS date_key, count(*) FILTER (before IS NULL) AS started, count(*) FILTER (state = 'signup' AND before = 'error') AS rejoined, count(*) FILTER (state = 'error') AS failed,
           count(*) FILTER (state = 'view') AS viewed, count(*) FILTER (state = 'click') AS clicked, count(*) AS n_changes FROM s GROUP BY 1""")
def d7_state_funnel_daily(spark: SparkSession, sf: str) -> DataFrame:
    s = m.dim_customer_state(spark, sf).withColumn("before", F.lag("state").over(W.partitionBy("customer_id").orderBy("updated_at")))
    is_ = lambda x: F.col("state") == x
    return s.groupBy(date_key(F.col("updated_at")).alias("date_key")).agg(
        F.count_if(F.col("before").isNull()).alias("started"), F.count_if(is_("signup") & (F.col("before") == "error")).alias("rejoined"), F.count_if(is_("error")).alias("failed"), F.count_if(is_("view")).alias("viewed"),
        F.count_if(is_("click")).alias("clicked"), F.count("*").alias("n_changes"),
    )


@query(f"""WITH p AS ({PAYMENT_SQL}) SELECT payment_date_key, coalesce(state_at_payment, 'unknown') AS state_at_payment, count(*) AS n_payments, round(sum(payment_value) * 100) / 100 AS payment_value FROM p GROUP BY 1, 2""")
def d8_payment_outcomes_daily(spark: SparkSession, sf: str) -> DataFrame:
    p = m.fct_payment(spark, sf)
    return p.groupBy("payment_date_key", F.coalesce("state_at_payment", F.lit("unknown")).alias("state_at_payment")).agg(F.count("*").alias("n_payments"), F.sum("payment_value").cast(D).alias("payment_value"))


# --- dashboards -------------------------------------------------------------
def orders_between(o: DataFrame, start: int | None = None, end: int | None = None, status: str | None = None) -> DataFrame:
    """Optional filters; one that is absent is left out."""
    o = o.withColumn("order_date_key", date_key(F.col("purchase_at")))
    o = o if start is None else o.filter(F.col("order_date_key") >= start)
    o = o if end is None else o.filter(F.col("order_date_key") <= end)
    return o if status is None else o.filter(F.col("order_status") == status)


@query(f"WITH {ORDERS} SELECT sum(cents)::DOUBLE / 100 AS gmv, count(*) AS n_orders, (sum(cents)::DOUBLE / 100) / nullif(count(*), 0) AS aov FROM orders_m WHERE order_date_key BETWEEN 19960101 AND 19961231")
def m1_gmv_orders_aov(spark: SparkSession, sf: str) -> DataFrame:
    o = orders_between(m.stg_orders(spark, sf), 19960101, 19961231)
    return o.agg(*kpis(o))


DAILY = f"WITH {ORDERS} SELECT order_date_key, sum(cents)::DOUBLE / 100 AS gmv, count(*) AS n_orders, (sum(cents)::DOUBLE / 100) / nullif(count(*), 0) AS aov FROM orders_m"


@query(f"{DAILY} GROUP BY 1")
def m2_daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    o = orders_between(m.stg_orders(spark, sf))
    return o.groupBy("order_date_key").agg(*kpis(o))


@query(f"{DAILY} WHERE order_date_key >= 19970101 AND order_status = 'DELIVERED' GROUP BY 1")
def m2_daily_sales_filtered(spark: SparkSession, sf: str) -> DataFrame:
    o = orders_between(m.stg_orders(spark, sf), start=19970101, status="DELIVERED")
    return o.groupBy("order_date_key").agg(*kpis(o))


SOLD = f"WITH {ORDERS}, {ITEMS}, sold AS (SELECT i.product_id, coalesce(nullif(p_type, 'ECONOMY'), 'uncategorised') AS category_name, i.cents + freight AS gross, o.order_status FROM items_m i JOIN part ON p_partkey = product_id LEFT JOIN orders_m o USING (order_id))"


def sold(spark: SparkSession, sf: str) -> DataFrame:
    p = m.dim_product(spark, sf).select("product_id", F.coalesce("category_name", F.lit("uncategorised")).alias("category_name"))
    return m.fct_order_item(spark, sf).join(p, "product_id")


def top(df: DataFrame, by: str, k: int, tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc(by), tiebreak).limit(k)


@query(f"{SOLD} SELECT category_name, sum(gross)::DOUBLE / 100 AS gmv, sum(CASE WHEN order_status = 'DELIVERED' THEN gross ELSE 0 END)::DOUBLE / 100 AS delivered_gmv FROM sold GROUP BY 1")
def m3_category_gmv(spark: SparkSession, sf: str) -> DataFrame:
    done = F.when(F.col("order_status") == "DELIVERED", F.col("line_gross")).otherwise(F.expr("0BD"))
    return sold(spark, sf).groupBy("category_name").agg(F.sum("line_gross").cast(D).alias("gmv"), F.sum(done).cast(D).alias("delivered_gmv"))


@query(f"{SOLD} SELECT product_id, sum(gross)::DOUBLE / 100 AS gmv FROM sold WHERE order_status = 'DELIVERED' GROUP BY 1 ORDER BY sum(gross) DESC, product_id LIMIT 10")
def m4_top_products_by_gmv(spark: SparkSession, sf: str) -> DataFrame:
    g = sold(spark, sf).filter("order_status = 'DELIVERED'").groupBy("product_id").agg(F.sum("line_gross").alias("gmv"))
    return top(g, "gmv", 10, "product_id").withColumn("gmv", F.col("gmv").cast(D))


@query(f"{SOLD} SELECT product_id, count(*) AS n_items FROM sold WHERE order_status = 'DELIVERED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def m5_top_products_by_volume(spark: SparkSession, sf: str) -> DataFrame:
    return top(sold(spark, sf).filter("order_status = 'DELIVERED'").groupBy("product_id").agg(F.count("*").alias("n_items")), "n_items", 10, "product_id")


@query(f"WITH {ORDERS} SELECT n_name AS customer_state, count(*) AS n_orders, sum(cents)::DOUBLE / 100 AS gmv FROM orders_m JOIN customer ON c_custkey = customer_id LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def m9_orders_by_state(spark: SparkSession, sf: str) -> DataFrame:
    # Summed by customer first: the join then moves one row for each customer.
    per = m.stg_orders(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("order_value").alias("v"))
    return per.join(m.dim_customer_geo(spark, sf), "customer_id").groupBy("customer_state").agg(F.sum("n").alias("n_orders"), F.sum("v").cast(D).alias("gmv"))


@query(f"WITH {ORDERS}, {TIERS} SELECT tier, count(*) AS n_customers FROM tiers GROUP BY 1")
def m10_tier_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return m.tiers(m.stg_orders(spark, sf)).groupBy("tier").agg(F.count("*").alias("n_customers"))


@query(f"WITH {ORDERS}, {TIERS} SELECT order_date_key, tier, count(DISTINCT customer_id) AS n_customers FROM orders_m JOIN tiers USING (customer_id) GROUP BY 1, 2")
def m11_tier_trend_daily(spark: SparkSession, sf: str) -> DataFrame:
    o = m.stg_orders(spark, sf)
    return o.select("customer_id", date_key(F.col("purchase_at")).alias("order_date_key")).distinct().join(m.tiers(o).select("customer_id", "tier"), "customer_id").groupBy("order_date_key", "tier").agg(F.count("*").alias("n_customers"))


@query(f"WITH {VERSIONS} SELECT state, count(DISTINCT customer_id) AS n_customers FROM versions WHERE is_current GROUP BY 1 ORDER BY 2 DESC, 1")
def m12_current_state_distribution(spark: SparkSession, sf: str) -> DataFrame:
    v = m.dim_customer_state(spark, sf).filter("is_current")
    return v.groupBy("state").agg(F.count_distinct("customer_id").alias("n_customers")).orderBy(F.desc("n_customers"), "state")


@query(f"WITH {ORDERS}, f AS (SELECT customer_id, min(purchase_at) AS first_at FROM orders_m GROUP BY 1) SELECT CAST(strftime(first_at, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n_customers FROM f GROUP BY 1")
def d12_first_order_day(spark: SparkSession, sf: str) -> DataFrame:
    first = m.stg_orders(spark, sf).groupBy("customer_id").agg(F.min("purchase_at").alias("first_at"))
    return first.groupBy(date_key(F.col("first_at")).alias("date_key")).agg(F.count("*").alias("n_customers"))


@query("SELECT c_custkey AS customer_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def c20_customers_without_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = m.table(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"))
    return m.table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")).join(o, "customer_id", "left_anti")


@query(f"WITH {ORDERS} SELECT order_id, customer_id, order_status FROM orders_m WHERE order_status IN ('PROCESSING', 'SHIPPED') AND purchase_at > TIMESTAMP '2001-01-01' ORDER BY purchase_at, order_id")
def b18_open_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = m.stg_orders(spark, sf).filter(F.col("order_status").isin("PROCESSING", "SHIPPED") & (F.col("purchase_at") > F.lit("2001-01-01").cast("timestamp_ntz")))
    return o.orderBy("purchase_at", "order_id").select("order_id", "customer_id", "order_status")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def e14_extraction_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(m.table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "ordinal")


@query("SELECT sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 AS amount, count(*) AS n_rows, l_returnflag AS bucket FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY l_returnflag")
def p1_filtered_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    d = m.table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")))
    return d.groupBy(F.col("l_returnflag").alias("bucket")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast(D).alias("_c"), F.count("*").alias("n_rows")).select((F.col("_c") / 100).alias("amount"), "n_rows", "bucket")
