"""Queries of tables that are kept and brought up to date: merged dimensions and facts, maintained hashes, bucketed facts, listings, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import date_key
from ..operators import hashing
from ..operators.history import as_of_join_by_window, scd2_fold, with_surrogate_key
from ..operators.stored import StoredDimension, merge_facts
from ..sources import commits, ledger, scans
from ..sources.bucketed import store_bucketed
from ..sources.contracts import EVENTS
from ..sources.parts import PartitionedTable, table_metrics, write_observed
from . import contracts as k
from . import model as m
from .ingest import DAY, bronze_by_day, committed_days, scratch, stamp, stored
from .registry import ITEMS, ORACLE_SQL, ORDERS, VERSIONS, query

D = "double"
BUCKETS = 16


# --- dimensions -------------------------------------------------------------------
def late_events(df: DataFrame) -> DataFrame:
    """What a first run has read: no batch after the 20th, and every fifth event still missing."""
    return df.filter("_batch_id <= '20240120' AND _ingested_at % 5 <> 0")


def merged_states(spark: SparkSession, sf: str) -> tuple[StoredDimension, DataFrame]:
    """The dimension of user states after two merges, and the report of the second, which brings late, back-dated and new observations."""
    seen = stored(m.observations(spark, sf))
    dim = StoredDimension(spark, scratch(spark), seen.schema, "customer_id", "attribute_hash", "updated_at", "customer_key", BUCKETS)
    dim.merge(late_events(seen))
    return dim, dim.merge(seen.filter("NOT (_batch_id <= '20240120' AND _ingested_at % 5 <> 0)"))


@query(f"""WITH {VERSIONS} SELECT customer_id, state, CAST(version AS INTEGER) AS version, strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to, is_current, customer_key FROM versions""")
def j3_incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Observations merged in two runs, the second with late ones; the versions must be those of a fold of all."""
    dim, _ = merged_states(spark, sf)
    return dim.versions().select("customer_id", "state", "version", stamp("valid_from"), stamp("valid_to"), "is_current", "customer_key")


EARLY = VERSIONS.replace("obs AS", "e_obs AS").replace("FROM events WHERE event_type <> 'purchase'", "FROM events WHERE event_type <> 'purchase' AND strftime(ts, '%Y%m%d') <= '20240120' AND event_id % 5 <> 0").replace("changed AS (SELECT * FROM obs", "e_changed AS (SELECT * FROM e_obs").replace("versions AS", "e_versions AS").replace("FROM changed", "FROM e_changed")


@query(f"""WITH {VERSIONS}, {EARLY}, sides AS (SELECT customer_id, effective_from, customer_key FROM versions UNION ALL SELECT customer_id, effective_from, customer_key FROM e_versions),
    one AS (SELECT customer_id, effective_from FROM sides GROUP BY customer_id, effective_from, customer_key HAVING count(*) = 1)
    SELECT customer_id, CASE WHEN min(one.effective_from) > TIMESTAMP '1900-01-01' THEN strftime(min(one.effective_from), '%Y-%m-%d %H:%M:%S.%f') ELSE 'beginning' END AS changed_from,
           coalesce(any_value(n.customer_key <> o.customer_key), false) AS first_moved
    FROM one LEFT JOIN (SELECT * FROM versions WHERE version = 1) n USING (customer_id) LEFT JOIN (SELECT * FROM e_versions WHERE version = 1) o USING (customer_id) GROUP BY customer_id""")
def e10_merge_report(spark: SparkSession, sf: str) -> DataFrame:
    """From when a merge changes a key's versions, and whether its first version has another surrogate key."""
    _, report = merged_states(spark, sf)
    at = F.when(F.col("changed_from") > F.lit("1900-01-01").cast("timestamp_ntz"), F.date_format("changed_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("beginning")
    return report.select("customer_id", at.alias("changed_from"), "first_moved")


# --- facts --------------------------------------------------------------------------
FACT = ["order_id", "order_status", "order_date_key", "n_items", "order_value"]


def facts(spark: SparkSession, sf: str, orders: DataFrame, items: DataFrame) -> DataFrame:
    built = m.fct_order(spark, sf, orders, items).select(*FACT[:4], F.col("order_value").cast(D).alias("order_value"))
    return built.withColumn("order_month", F.expr("order_date_key DIV 100").cast("int"))


def merged_facts(spark: SparkSession, sf: str) -> PartitionedTable:
    """fct_order by month after two runs. The first has read orders up to July, some of them under an earlier day, and lines shipped up to August."""
    after = lambda c, day: F.col(c) > F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    orders, items = stored(m.stg_orders(spark, sf)), stored(m.stg_order_items(spark, sf))
    is_moved = (F.col("order_id") % 90 == 7) & after("purchase_at", "2001-03-01")
    moved = orders.filter(is_moved).select("order_id")
    early = orders.filter(~after("purchase_at", "2001-07-01")).withColumn("purchase_at", F.when(is_moved, F.col("purchase_at") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("purchase_at")))
    first = facts(spark, sf, early, items.filter(~after("shipped_at", "2001-08-01")))
    table = PartitionedTable(spark, scratch(spark), "order_month", first.schema)
    merge_facts(table, stored(first), spark.createDataFrame([], "order_id bigint"), ["order_id"], "20010701")
    causes = [orders.filter(after("purchase_at", "2001-07-01")).select("order_id"), items.filter(after("shipped_at", "2001-08-01")).select("order_id"), moved]
    affected = stored(causes[0].unionByName(causes[1]).unionByName(causes[2]).distinct())
    again = lambda df: df.join(affected, "order_id", "left_semi")
    merge_facts(table, stored(facts(spark, sf, again(orders), again(items))), affected, ["order_id"], "20011231")
    return table


FACT_SQL = f"WITH {ORDERS}, {ITEMS} SELECT order_id, order_status, order_date_key, (SELECT count(*) FROM items_m i WHERE i.order_id = o.order_id) AS n_items, cents / 100.0::DOUBLE AS order_value FROM orders_m o"


@query(FACT_SQL)
def j6_partitioned_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in partitions by month, of which a run replaces those that hold affected orders; the rows must be those of a full build."""
    return merged_facts(spark, sf).read().select(*FACT)


@query("SELECT '20011231' AS bound, count(*) AS n_rows, true AS same_hash FROM orders")
def l7_maintained_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The hash that commits keep up by the rows they add and remove, against one taken over the whole table."""
    table = merged_facts(spark, sf)
    whole = hashing.logical_hash(table.read())
    return whole.select(F.lit(table.meta()["bound"]).alias("bound"), "n_rows", (F.col("logical_hash") == table.hash()).alias("same_hash"))


# --- as-of joins -----------------------------------------------------------------------
ACCOUNT_SQL = f"""WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS account FROM events),
    a_obs AS (SELECT account, event_type AS state, ts, event_id FROM e WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY account, ts, event_type ORDER BY event_id DESC) = 1),
    a_changed AS (SELECT * FROM a_obs WINDOW w AS (PARTITION BY account ORDER BY ts, event_id) QUALIFY lag(state) OVER w IS DISTINCT FROM state),
    a_versions AS (SELECT account, state, CASE WHEN row_number() OVER w = 1 THEN TIMESTAMP '1600-01-01' ELSE ts END AS effective_from, lead(ts) OVER w AS valid_to FROM a_changed WINDOW w AS (PARTITION BY account ORDER BY ts, event_id))
    SELECT e.event_id AS payment_id, e.account, v.state FROM e LEFT JOIN a_versions v ON v.account = e.account AND e.ts >= v.effective_from AND (v.valid_to IS NULL OR e.ts < v.valid_to) WHERE event_type = 'purchase'"""
#: Events of an account in a slice: so few that the tables here have accounts with more.
ACCOUNT_SLICE = 100


@query(ACCOUNT_SQL)
def j4_sliced_as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """Payments with their account's state in force, where one account holds a third of all events and changes state all the time."""
    e = m.table(spark, sf, "events").withColumn("account", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    seen = e.filter("event_type <> 'purchase'").groupBy("account", "ts", F.col("event_type").alias("state")).agg(F.max("event_id").alias("event_id"))
    versions = scd2_fold(seen, "account", "state", "ts", tiebreak=("event_id",))
    paid = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("payment_id"), "account", "ts")
    return as_of_join_by_window(paid, versions, "account", "ts", ["state"], ACCOUNT_SLICE).select("payment_id", "account", "state")


# --- bucketed facts ----------------------------------------------------------------------
def bucketed_sources(spark: SparkSession, sf: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Orders, lines and payments of orders stored by order, as the staging of a run leaves them for the facts."""
    found = {"orders": k.orders_with_customer(spark, sf), "items": m.stg_order_items(spark, sf), "payments": k.order_payments(spark, sf)}
    return {n: store_bucketed(df, scratch(spark), "order_id", buckets) for n, df in found.items()}


def fct_order_payment_of(payments: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select("order_id", "customer_key", date_key(F.col("purchase_at")).alias("purchase_date_key"))
    pay = payments.select("order_id", "payment_sequence", "payment_status", "payment_value")
    return pay.join(o, "order_id", "left").select("order_id", "payment_sequence", "customer_key", "purchase_date_key", "payment_status", F.col("payment_value").cast(D).alias("payment_value"))


@query(FACT_SQL)
def j11_bucketed_fct_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and the totals of their lines, both stored in buckets of the order: no exchange."""
    s = bucketed_sources(spark, sf)
    return facts(spark, sf, s["orders"].drop("customer_key"), s["items"]).select(*FACT)


def j13_bucketed_order_payment(spark: SparkSession, sf: str) -> DataFrame:
    """Payments with their order's customer and day, both stored in buckets of the order: no exchange."""
    s = bucketed_sources(spark, sf)
    return fct_order_payment_of(s["payments"], s["orders"])


query(ORACLE_SQL["j13_fct_order_payment"])(j13_bucketed_order_payment)


# --- listings, manifests, differences --------------------------------------------------------
@query(f"SELECT {DAY} AS batch_id, 'UNCOMMITTED' AS why, count(*) AS n_rows, true AS has_bytes FROM events WHERE {DAY} > '20240125' GROUP BY 1 UNION ALL SELECT '20240103', 'UNKNOWN_FILE', count(*), true FROM events WHERE {DAY} = '20240103' AND event_id % 2 = 0")
def a24_unlisted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files on storage that no commit stands for: batches after the last commit, and what a later writer left in a committed one."""
    root = scratch(spark)
    bronze = bronze_by_day(spark, sf, root)
    book = committed_days(bronze).filter("batch_id <= '20240125'")
    named = stored(scans.list_files(spark, root).select("path"))
    # A second writer died after it had written into a committed batch.
    bronze.filter("batch_id = '20240103' AND event_id % 2 = 0").drop("batch_id").write.mode("append").parquet(f"{root}/batch_id=20240103")
    files = ledger.unlisted_files(scans.list_files(spark, root), book, "events", named)
    # What the files hold, each told by the file that a row is read from.
    rows = spark.read.schema(EVENTS.schema).parquet(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    return files.join(rows, "path").groupBy("batch_id", "why").agg(F.sum("rows").alias("n_rows"), (F.min("length") > 0).alias("has_bytes"))


def observed_sql(table: str, key: str, fields: str) -> str:
    lanes = " || ':' || ".join(f"sum(('0x' || substr(h, {16 * i + 1}, 15))::BIGINT::HUGEINT)::VARCHAR" for i in range(4))
    return f"SELECT '{table}' AS relation, count(*) AS n_rows, sha256(count(*) || ':' || {lanes}) AS logical_hash, min({key}) AS first_key, max({key}) AS last_key FROM (SELECT {key}, sha256(to_json({{{fields}}})::VARCHAR) AS h FROM {table})"


@query(" UNION ALL ".join(observed_sql(*x) for x in (
    ("customer", "c_custkey", "c_acctbal: c_acctbal::VARCHAR, c_custkey: c_custkey, c_mktsegment: c_mktsegment, c_name: c_name, c_nationkey: c_nationkey"),
    ("supplier", "s_suppkey", "s_acctbal: s_acctbal::VARCHAR, s_name: s_name, s_nationkey: s_nationkey, s_suppkey: s_suppkey"),
    ("orders", "o_orderkey", "o_custkey: o_custkey, o_orderdate: strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') || '+00', o_orderkey: o_orderkey, o_orderpriority: o_orderpriority, o_orderstatus: o_orderstatus, o_totalprice: o_totalprice::VARCHAR"),
)))
def a26_observed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, hash and key range of each table out of the job that writes it."""
    rows = []
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
        df = m.table(spark, sf, name)
        got = write_observed(df, scratch(spark), table_metrics(df) | {"lo": F.min(key), "hi": F.max(key)})
        rows.append((name, int(got["n_rows"]), hashing.hash_of(got), got["lo"], got["hi"]))
    return spark.createDataFrame(rows, "relation string, n_rows bigint, logical_hash string, first_key bigint, last_key bigint")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 500 = 0 THEN 'left_only' ELSE 'changed' END AS status FROM orders WHERE o_orderkey % 500 = 0 OR o_orderkey % 777 = 1
    UNION ALL SELECT o_orderkey + 1000000000, 'right_only' FROM orders WHERE o_orderkey % 900 = 2""")
def l5_tree_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that two builds differ in; rows in leaves of equal digests never reach the join."""
    left = m.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    right = left.filter("k % 500 <> 0").withColumn("o_custkey", F.when(F.col("k") % 777 == 1, -1).otherwise(F.col("o_custkey")))
    # Of another source, which may use an order's number: the key is both.
    right = right.unionByName(left.filter("k % 900 = 2").withColumns({"source": F.lit("other"), "k": F.col("k") + 1_000_000_000}))
    return hashing.tree_difference(left, right, ["source", "k"]).select("k", "status")


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'SHORT' WHEN c_custkey % 13 = 0 THEN 'LONG' WHEN c_custkey % 17 = 0 THEN 'QUOTE' WHEN c_custkey % 19 = 0 THEN 'TYPE' ELSE '' END AS kind FROM customer)
    SELECT kind, count(*) AS n_rows, count(*) FILTER (kind = '') AS n_good, coalesce(sum(c_custkey) FILTER (kind = ''), 0)::BIGINT AS good_keys FROM c GROUP BY kind""")
def a1_corrupt_records(spark: SparkSession, sf: str) -> DataFrame:
    """customer as CSV of which some lines lack a field, have one too many, leave a quote open or have a word for a number."""
    c, path = m.table(spark, sf, "customer"), scratch(spark)
    off = lambda n: F.col("c_custkey") % n == 0
    key, name, rest = F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', esq"')), F.col("c_nationkey").cast("string")
    line = F.when(off(11), F.concat_ws(",", key, name)).when(off(13), F.concat_ws(",", key, name, rest, F.lit("more"))).when(off(17), F.concat_ws(",", key, F.concat(F.lit('"'), F.col("c_name")), rest))
    line = line.when(off(19), F.concat_ws(",", key, name, F.lit("seven"))).otherwise(F.concat_ws(",", key, name, rest))
    c.select(line.alias("value")).write.text(path)
    schema = F.struct(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"))
    # Written out, as Spark reads the corrupt column alone only from a table.
    read = stored(scans.read_permissive_csv(spark, path, c.select(schema.alias("s")).schema["s"].dataType, header=False))
    bad = F.col(scans.CORRUPT)
    kind = F.coalesce(F.when(bad.isNotNull(), scans.corrupt_kind(bad, 3)), F.lit(""))
    return read.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_rows"), F.count_if(bad.isNull()).alias("n_good"), F.coalesce(F.sum(F.when(bad.isNull(), F.col("c_custkey"))), F.lit(0)).alias("good_keys"))


# --- replay ---------------------------------------------------------------------------------
def marts_of(events: DataFrame) -> dict[str, DataFrame]:
    """The marts of events, from nothing but the events given."""
    states, paid = m.customer_states(m.observations_of(events)), m.purchases_of(events)
    facts_ = m.payments_in_state(paid, states)
    daily = facts_.groupBy("payment_date_key", "state_at_payment").agg(F.count("*").alias("n_payments"), F.sum("payment_value").alias("payment_total"))
    return {"dim_customer_state": states, "fct_payment": facts_, "rpt_payments_daily": daily}


def replayed(spark: SparkSession, path: str, book: DataFrame, schema, as_of: str) -> dict[str, DataFrame]:
    """The marts built from exactly the files that were committed by a boundary, as the ledger has it."""
    return marts_of(ledger.bronze_source(spark, path, ledger.committed(book, as_of), schema).select(*EVENTS.schema.names))


@query(f"""WITH {VERSIONS.replace("FROM events WHERE", f"FROM events WHERE {DAY} <= '20240115' AND")}, paid AS (SELECT e.*, v.state FROM events e LEFT JOIN versions v ON v.customer_id = e.user_id AND e.ts >= v.effective_from AND (v.valid_to IS NULL OR e.ts < v.valid_to) WHERE event_type = 'purchase' AND {DAY} <= '20240115')
    SELECT relation, n_rows, true AS same_as_published, relation <> 'none' AS changed_since FROM (SELECT 'dim_customer_state' AS relation, (SELECT count(*) FROM versions) AS n_rows UNION ALL SELECT 'fct_payment', (SELECT count(*) FROM paid)
    UNION ALL SELECT 'rpt_payments_daily', (SELECT count(*) FROM (SELECT DISTINCT ts::DATE, state FROM paid)))""")
def j16_replay_marts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole marts published at a time, then more batches committed and published, then the first ones built again as of that time."""
    from .publish import Publisher

    path = scratch(spark)
    bronze = bronze_by_day(spark, sf, path)
    rows = committed_days(bronze)
    book = commits.Ledger(spark, scratch(spark))
    pub = Publisher(spark, scratch(spark), dict.fromkeys(("dim_customer_state", "fct_payment", "rpt_payments_daily"), "payments"))
    hashes = []
    for lower, upper in (("", "20240115"), ("20240115", "20240131")):
        book.commit(rows.filter((F.col("batch_id") > lower) & (F.col("batch_id") <= upper)), expected=lower, advance_to=upper)
        pub.publish(replayed(spark, path, book.rows(), bronze.schema, "2030-01-01T00:00:00Z"), [])
        hashes.append(pub.hashes())
    again = hashing.relation_hashes(replayed(spark, path, book.rows(), bronze.schema, "2024-01-16T00:00:00Z"))
    then = spark.createDataFrame([(n, h, hashes[1][n]) for n, h in hashes[0].items()], "relation string, then string, now string")
    return again.join(then, "relation").select("relation", "n_rows", (F.col("logical_hash") == F.col("then")).alias("same_as_published"), (F.col("then") != F.col("now")).alias("changed_since"))


# --- a source read by its cursor -------------------------------------------------------------
@query("SELECT event_id, user_id, event_type, epoch_us(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-25'")
def a5_cursor_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as they arrive in three parts, streamed by their cursor; the query is stopped and started between the parts, in the middle of a day and between rows of one time."""
    from ..streaming.cursor import read_cursor_stream

    source, out, checkpoint = (scratch(spark) for _ in range(3))
    e = m.table(spark, sf, "events").select(*EVENTS.schema.names).filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"))
    cuts = [None, *[scans.bound(e, EVENTS, b) for b in (("2024-01-10 12:00:00", 3000), ("2024-01-20 00:00:00", 7000))], None]
    for lower, upper in zip(cuts, cuts[1:]):
        part = e if lower is None else e.filter(EVENTS.cursor_of() > lower)
        (part if upper is None else part.filter(EVENTS.cursor_of() <= upper)).write.mode("append").parquet(source)
        stream = read_cursor_stream(spark, source, EVENTS).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EVENTS.schema).parquet(out).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
