"""Reads, relations, counts and gates, told with the nouns of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import reads, relations, texts, usage
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: Event types stand for document types; no event is a refund, so that one is always missing.
_REQUIRED = (("view", "Viewed", "view"), ("purchase", "Bought", "purchase"), ("signup", "Signed up", "signup"), ("refund", "Refunded", "refund"))
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _buyers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = reads.scoped(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(buyers, orders.o_custkey == buyers.c_custkey).drop("c_custkey")


def _last_event(events: DataFrame) -> Column:
    """The time of the newest event, in place of the clock, as a one-value scalar subquery."""
    return events.agg(F.max("ts").alias("anchor")).scalar()


@register(
    "A3_children_count",
    """
    SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, coalesce(n.cnt, 0) AS n_lines
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'
    LEFT JOIN (SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey
    """,
)
def a3_children_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one segment, newest first, with their number of lines."""
    counted = relations.with_child_count(_buyers_orders(spark, sf_dir), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "n_lines")
    return counted.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@register(
    "A3_two_child_counts",
    """
    SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers,
           (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS n_suppliers
    FROM nation
    """,
)
def a3_two_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with its customers and its rich suppliers; no count multiplies the other."""
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counted = relations.with_child_count(nations, table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey", "n_customers")
    return relations.with_child_count(counted, rich, "n_nationkey", "s_nationkey", "n_suppliers")


@register("S2_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.scoped(table(spark, sf_dir, "orders"), o_orderkey=77)
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@register("S3_exactly_one", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def s3_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.exactly_one(reads.scoped(table(spark, sf_dir, "customer"), c_custkey=7).select("c_custkey", "c_name"))


@register(
    "F1_scoped_filter",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'",
)
def f1_scoped_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.scoped(table(spark, sf_dir, "orders"), o_custkey=7, o_orderstatus="F").select("o_orderkey", "o_orderdate")


@register(
    "F7_any_match",
    "SELECT user_id, bool_or(event_type IN ('error', 'purchase') AND value > 49) AS busy FROM events GROUP BY user_id",
)
def f7_any_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some event of a user is of the given types and dear."""
    return reads.any_match(table(spark, sf_dir, "events"), "user_id", F.col("event_type").isin("error", "purchase") & (F.col("value") > 49), "busy")


@register(
    "F4_expired",
    "SELECT event_id, ts + INTERVAL 14 DAY <= (SELECT max(ts) FROM events) AS is_expired FROM events",
)
def f4_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of fourteen days that began with each event, seen from the newest one."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", reads.expired(F.col("ts") + F.expr("INTERVAL 14 DAYS"), _last_event(events)).alias("is_expired"))


@register(
    "J1_inner",
    """
    SELECT e.event_id, e.ts, c.c_custkey, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
    WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
    """,
)
def j1_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's events with the customer each must have."""
    events = table(spark, sf_dir, "events")
    last = reads.recent(events, "ts", _last_event(events)).select("event_id", "ts", "user_id")
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return last.join(owners, last.user_id == owners.c_custkey).drop("user_id")


@register(
    "J2_feed_left_actor",
    """
    SELECT e.event_id, e.ts, e.event_type, c.c_name AS actor
    FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON e.user_id = c.c_custkey
    """,
)
def j2_feed_left_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, with their actor where that one is of the segment."""
    actors = reads.scoped(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING").select("c_custkey", F.col("c_name").alias("actor"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id")
    return events.join(actors, events.user_id == actors.c_custkey, "left").select("event_id", "ts", "event_type", "actor")


@register(
    "J3_optional_one",
    """
    SELECT d.doc_id, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS is_labelled
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def j3_optional_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its label, of which there is one or none."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = docs.join(labels, docs.doc_id == labels.labelled_id, "left")
    return joined.select("doc_id", "lang", "quality", "toxic", F.col("labelled_id").isNotNull().alias("is_labelled"))


@register(
    "J4_ordered_children",
    """
    SELECT o.o_orderkey, coalesce(l.n, 0) AS n_lines, coalesce(l.parts, '') AS parts
    FROM orders o LEFT JOIN (
      SELECT l_orderkey, count(*) AS n,
             string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS parts
      FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    """,
)
def j4_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines in order, the nested rows told as a list of parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER)
    nested = relations.with_children(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", _LINE_ORDER, "lines")
    parts = F.array_join(F.transform("lines", lambda r: r["l_partkey"].cast("string")), ",")
    return nested.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), parts.alias("parts"))


@register(
    "J5_latest_child",
    """
    SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_orderdate FROM customer c LEFT JOIN (
      SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    ) o ON o.o_custkey = c.c_custkey
    """,
)
def j5_latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the newest order, customers without orders included."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = relations.latest_child(table(spark, sf_dir, "customer"), orders, "c_custkey", "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("c_custkey", "c_name", "o_orderkey", "o_orderdate")


@register(
    "O4_latest_done",
    """
    SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    """,
)
def o4_latest_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished order of each customer that has one."""
    done = reads.scoped(table(spark, sf_dir, "orders"), o_orderstatus="F").select("o_custkey", "o_orderkey", "o_orderdate")
    return relations.first_per_key(done, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@register(
    "J7_first_membership",
    """
    SELECT c.c_custkey, c.c_name, o.o_orderkey AS first_order FROM customer c JOIN (
      SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
    ) o ON o.o_custkey = c.c_custkey
    """,
)
def j7_first_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through their earliest order."""
    first = relations.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")])
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return owners.join(first, owners.c_custkey == first.o_custkey).select("c_custkey", "c_name", F.col("o_orderkey").alias("first_order"))


@register(
    "J8_fan_in",
    """
    SELECT o.o_orderkey, o.o_orderstatus, c.c_name, coalesce(l.n, 0) AS n_lines, l.last_ship
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    """,
)
def j8_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read separately about an order, brought together."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_ship"))
    joined = orders.join(owners, "o_custkey", "left").join(lines, "o_orderkey", "left")
    return joined.select("o_orderkey", "o_orderstatus", "c_name", F.coalesce("n", F.lit(0)).alias("n_lines"), "last_ship")


@register("O2_newest_200", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def o2_newest_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 200, F.desc("o_orderdate"), F.desc("o_orderkey"))


@register("O3_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def o3_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller asks for 1000 rows and gets the most that are given."""
    return reads.page(table(spark, sf_dir, "events").select("event_id", "ts"), 1000, F.desc("ts"), F.desc("event_id"))


@register(
    "A1_overview",
    """
    SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM orders) AS orders,
           (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS events_24h
    """,
)
def a1_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four counts at once, as scalar subqueries of one row."""
    count = lambda df: df.agg(F.count("*")).scalar()
    events = table(spark, sf_dir, "events")
    recent = reads.recent(events, "ts", _last_event(events))
    counts = {name: count(table(spark, sf_dir, t)) for name, t in (("customers", "customer"), ("suppliers", "supplier"), ("orders", "orders"))}
    return spark.range(1).select(*[c.alias(name) for name, c in counts.items()], count(recent).alias("events_24h"))


@register(
    "A2_last_24h",
    """
    SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY event_type
    """,
)
def a2_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return reads.recent(events, "ts", _last_event(events)).groupBy("event_type").agg(F.count("*").alias("n"))


@register(
    "A4_next_version",
    """
    SELECT o.o_orderkey, coalesce(max(l.l_linenumber), 0) + 1 AS next_line
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey
    """,
)
def a4_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that an order's next line would get."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relations.with_next_number(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", "l_linenumber", "next_line")


@register("A10_distinct_set", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def a10_distinct_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), ",")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("kinds"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    measures = {"ai_analyze_count": F.col("event_type") == "click", "draft_gen_count": F.col("event_type") == "purchase"}
    return usage.monthly_usage(events, "user_id", "ts", measures)


_USAGE_SQL = """
    SELECT user_id, strftime(ts, '%Y-%m') AS year_month, count(*) FILTER (WHERE event_type = 'click') AS ai_analyze_count,
           count(*) FILTER (WHERE event_type = 'purchase') AS draft_gen_count FROM events GROUP BY 1, 2
"""


@register("A5_usage_monthly", _USAGE_SQL)
def a5_usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


@register(
    "W9_limit_gate",
    f"""
    SELECT *, ai_analyze_count >= ai_limit AS ai_blocked, draft_gen_count >= draft_limit AS draft_blocked FROM (
      SELECT *, CASE plan_code WHEN 'demo' THEN 20 ELSE 500 END AS ai_limit, CASE plan_code WHEN 'demo' THEN 10 ELSE 200 END AS draft_limit FROM (
        SELECT u.*, CASE WHEN s.quality = 1 THEN 'starter' ELSE 'demo' END AS plan_code
        FROM ({_USAGE_SQL}) u LEFT JOIN labels s ON s.doc_id = u.user_id))
    """,
)
def w9_limit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who has used up a month's limits; a good label stands for a subscription, and who has none is on the default plan."""
    starters = reads.scoped(table(spark, sf_dir, "labels"), quality=1).select(F.col("doc_id").alias("user_id"), F.lit("starter").alias("plan_code"))
    return usage.gate(usage.with_plan(_usage(spark, sf_dir), starters, "user_id"))


@register(
    "J6_checklist",
    """
    SELECT u.user_id, r.item_key, r.title, true AS required, CASE WHEN h.user_id IS NULL THEN 'missing' ELSE 'ok' END AS status,
           CASE WHEN h.user_id IS NULL THEN 'Нет активного документа этого типа' END AS note
    FROM (SELECT DISTINCT user_id FROM events) u
    CROSS JOIN (VALUES ('view', 'Viewed'), ('purchase', 'Bought'), ('signup', 'Signed up'), ('refund', 'Refunded')) r(item_key, title)
    LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-28') h
      ON h.user_id = u.user_id AND h.event_type = r.item_key
    """,
)
def j6_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required kinds of event each user had in the last days."""
    events = table(spark, sf_dir, "events")
    late = events.filter(F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz"))
    return texts.checklist(events.select("user_id").distinct(), "user_id", late, "user_id", "event_type", _REQUIRED)
