"""Changes of tables as new tables, told with orders, lines and monthly counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import usage, writes
from ledgerloom.plans.registry import register
from ledgerloom.session import table

_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@register(
    "W1_update",
    """
    SELECT o.o_orderkey, CASE WHEN c.k IS NULL THEN o.o_orderstatus ELSE 'X' END AS o_orderstatus,
           CASE WHEN c.k IS NULL THEN o.o_totalprice ELSE c.total END AS o_totalprice
    FROM orders o LEFT JOIN (SELECT l_orderkey AS k, CASE WHEN count(*) > 4 THEN NULL ELSE sum(l_quantity) END AS total
                             FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.k = o.o_orderkey
    """,
)
def w1_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with returned lines get a status and a total; a null that is set stays set."""
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    changed = returned.agg(F.when(F.count("*") <= 4, F.sum("l_quantity")).alias("o_totalprice")).withColumn("o_orderstatus", F.lit("X"))
    return writes.update_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), changed, "o_orderkey")


@register("W2_delete", f"SELECT {_ORDER} FROM orders WHERE o_orderstatus <> 'P'")
def w2_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_matching(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P")


@register("W2_delete_by_key", f"SELECT {_ORDER} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def w2_delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders left when those of customers in debt go."""
    debtors = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders")
    return writes.delete_by_key(orders, debtors, "o_custkey").select(*orders.columns)


def _counted(events: DataFrame) -> DataFrame:
    return usage.monthly_usage(events, "user_id", "ts", {"clicks": F.col("event_type") == "click", "purchases": F.col("event_type") == "purchase"})


@register(
    "W3_upsert_increment",
    """
    SELECT user_id, strftime(ts, '%Y-%m') AS year_month, count(*) FILTER (WHERE event_type = 'click') AS clicks,
           count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2
    """,
)
def w3_upsert_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the first half of the month with those of the second added."""
    events = table(spark, sf_dir, "events")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = _counted(events.filter(F.col("ts") < half)), _counted(events.filter(F.col("ts") >= half))
    return usage.add_usage(old, new, ["user_id", "year_month"], ["clicks", "purchases"])


@register(
    "W4_get_or_create",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'starter' ELSE 'demo' END AS plan_code FROM customer
    """,
)
def w4_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions after every customer has looked at its own: who had none has the default one."""
    owners = table(spark, sf_dir, "customer")
    held = owners.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("starter").alias("plan_code"))
    return writes.insert_missing(held, owners.select("c_custkey", F.lit("demo").alias("plan_code")), "c_custkey")


@register(
    "W5_upsert_keep",
    """
    WITH o AS (SELECT c_custkey AS id, 'draft ' || c_name AS body, 'm1' AS model FROM customer WHERE c_acctbal >= 0),
    n AS (SELECT DISTINCT o_custkey AS id, o_custkey % 3 = 0 AS failed FROM orders WHERE o_orderstatus = 'P')
    SELECT coalesce(o.id, n.id) AS id,
           CASE WHEN n.id IS NULL THEN o.body WHEN NOT n.failed THEN 'new ' || n.id WHEN o.id IS NULL THEN '(none yet)' ELSE o.body END AS body,
           CASE WHEN n.id IS NOT NULL AND NOT n.failed THEN 'm2' ELSE o.model END AS model,
           CASE WHEN n.failed THEN 'draft_failed' END AS error
    FROM o FULL OUTER JOIN n ON o.id = n.id
    """,
)
def w5_upsert_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts after results of which some failed: a failure keeps the old body."""
    owners = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    old = owners.select(F.col("c_custkey").alias("id"), F.concat(F.lit("draft "), "c_name").alias("body"), F.lit("m1").alias("model"), F.lit(None).cast("string").alias("error"))
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    failed = F.col("id") % 3 == 0
    body, error = F.when(~failed, F.concat(F.lit("new "), F.col("id").cast("string"))), F.when(failed, "draft_failed")
    return writes.upsert_draft(old, ids.select("id", body.alias("body"), F.lit("m2").alias("model"), error.alias("error")), "(none yet)")


@register(
    "W6_replace_children",
    """
    SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_orderkey, -1, o_totalprice FROM orders WHERE o_orderstatus = 'P'
    """,
)
def w6_replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of some orders replaced by one line each."""
    chosen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    parents = chosen.select(F.col("o_orderkey").alias("l_orderkey"))
    new = chosen.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).cast("long").alias("l_partkey"), F.col("o_totalprice").alias("l_quantity"))
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return writes.replace_children(old, new, parents, "l_orderkey")


@register(
    "W8_audit",
    """
    SELECT event_id AS target_id, CAST(user_id AS VARCHAR) AS actor_user_id, 'tender.ai_analyze' AS action, 'Tender' AS target_type,
           '{"kind":"' || event_type || '"}' AS meta, ts AS created_at FROM events WHERE event_type = 'purchase'
    """,
)
def w8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each purchase."""
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    meta = F.struct(F.col("event_type").alias("kind"))
    return events.select(*writes.audit_event(F.col("user_id").cast("string"), "tender.ai_analyze", "Tender", F.col("event_id"), meta, F.col("ts")))
