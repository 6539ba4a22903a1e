"""The retail model over the shared tables: staging, dimensions and facts.

orders, lineitem, customer, part and supplier stand in for the retail source;
events are the observations of customer state, their day is the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import attribute_hash, date_key, money, standardize
from ..operators.history import as_of_join_by_window, current_records, date_dimension, dedupe_observations, scd2_fold, with_surrogate_key

# What the source's order statuses stand for here.
STATUS = {"F": "DELIVERED", "O": "SHIPPED", "P": "PROCESSING"}
TIER_STEPS = {"SILVER": 5, "GOLD": 15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), standardize(F.col("o_orderstatus"), STATUS).alias("order_status"), F.col("o_orderdate").alias("purchase_at"),
        money(F.col("o_totalprice")).alias("order_value"), F.col("o_orderpriority").alias("priority"),
    )


def stg_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current record of each line: the source repeats (order, line) pairs.

    Dealt by order, which serves the choice of the record here and the totals and
    joins by order that follow.
    """
    dealt = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    lines = current_records(dealt, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    freight = F.expr("(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) + 50) DIV 100")
    as_money = lambda c: (c.cast("decimal(16,0)") * F.expr("0.01BD")).cast("decimal(14,2)")
    return lines.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("shipped_at"),
        as_money(cents).alias("price"), as_money(freight).alias("freight_value"),
    )


def dim_customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_state"))
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), "customer_state")


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 1; one category stands for the missing ones."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("category_name"), F.col("p_brand").alias("brand"))


def dim_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"), F.col("s_nationkey").alias("nation_key"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(table(spark, sf_dir, "events"))


def observations_of(events: DataFrame) -> DataFrame:
    """State observations of users: all events but purchases; the event type is the state."""
    e = events.filter("event_type <> 'purchase'")
    obs = e.select(
        F.col("user_id").alias("customer_id"), F.col("event_type").alias("state"), F.col("ts").alias("updated_at"), attribute_hash({"state": F.col("event_type")}).alias("attribute_hash"),
        F.col("event_id").alias("_ingested_at"), F.date_format("ts", "yyyyMMdd").alias("_batch_id"),
    )
    return dedupe_observations(obs, "customer_id")


def dim_customer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_states(observations(spark, sf_dir))


def customer_states(observed: DataFrame) -> DataFrame:
    """Slowly changing dimension of user states with surrogate keys."""
    return with_surrogate_key(scd2_fold(observed, "customer_id", "attribute_hash", "updated_at"), "customer_id", "attribute_hash", "customer_key")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases_of(table(spark, sf_dir, "events"))


def purchases_of(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("payment_id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("payment_at"), money(F.col("value")).alias("payment_value"), F.date_format("ts", "yyyyMMdd").alias("_batch_id")
    )


def item_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum("price").cast("decimal(16,2)").alias("items_value"), F.sum("freight_value").cast("decimal(16,2)").alias("freight_value"), F.count("*").alias("n_items"), F.max("shipped_at").alias("delivered_at"))


def fct_order(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """An order with the totals of its lines; missing totals are 0, missing dates leave measures null."""
    orders = stg_orders(spark, sf_dir) if orders is None else orders
    joined = orders.join(item_totals(stg_order_items(spark, sf_dir) if items is None else items), "order_id", "left")
    zero = F.expr("0BD").cast("decimal(16,2)")
    return joined.select(
        "order_id", "customer_id", "order_status", "purchase_at", date_key(F.col("purchase_at")).alias("order_date_key"), "order_value",
        F.coalesce("items_value", zero).alias("items_value"), F.coalesce("freight_value", zero).alias("freight_value"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.datediff("delivered_at", "purchase_at").alias("days_to_delivery"), (F.col("delivered_at") > F.col("purchase_at") + F.expr("INTERVAL 90 DAYS")).alias("is_late"),
    )


def fct_order_item(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Lines with their order's status and date; a line without an order keeps null keys."""
    orders = stg_orders(spark, sf_dir).select("order_id", "order_status", "customer_id", date_key(F.col("purchase_at")).alias("order_date_key"))
    items = stg_order_items(spark, sf_dir) if items is None else items
    return items.join(orders, "order_id", "left").withColumn("line_gross", (F.col("price") + F.col("freight_value")).cast("decimal(16,2)"))


def fct_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_in_state(purchases(spark, sf_dir), dim_customer_state(spark, sf_dir))


def payments_in_state(paid: DataFrame, states: DataFrame) -> DataFrame:
    """Purchases with the state of the user in force at their time."""
    joined = as_of_join_by_window(paid, states, "customer_id", "payment_at", ["customer_key", "state"])
    return joined.select("payment_id", "customer_id", "customer_key", F.col("state").alias("state_at_payment"), date_key(F.col("payment_at")).alias("payment_date_key"), "payment_value", "_batch_id")


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at")).unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at")))
    return date_dimension(days, "at")


def tiers(orders: DataFrame) -> DataFrame:
    """customer_id, n_delivered, tier from the number of delivered orders."""
    n = F.count_if(F.col("order_status") == "DELIVERED")
    tier = F.when(F.col("n_delivered") >= TIER_STEPS["GOLD"], "GOLD").when(F.col("n_delivered") >= TIER_STEPS["SILVER"], "SILVER").otherwise("BRONZE")
    return orders.groupBy("customer_id").agg(n.alias("n_delivered")).withColumn("tier", tier)
