"""Relational operators beyond the reference's own: joins along time, merges, sketches, subtotals, frames, multisets, pages and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import grouping, merging, multisets, ranks, samples, sketches, temporal
from ledgerloom.operators.pages import PagedTable
from ledgerloom.plans.registry import register
from ledgerloom.session import new_folder, table

#: Orders are given a time within the month of the events, from their key.
_PLACED_SQL = "SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + (o_orderkey * 7919 % 43200) * INTERVAL 1 MINUTE AS placed FROM orders"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") * 7919 % 43200).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("placed"))


@register(
    "E_asof_order",
    f"""
    WITH o AS (SELECT o_custkey, placed, max(o_orderkey) AS o_orderkey FROM ({_PLACED_SQL}) GROUP BY o_custkey, placed)
    SELECT e.event_id, e.user_id, o.o_orderkey, o.placed FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.placed
    """,
)
def e_asof_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's newest order up to then; of two orders of one minute the later key."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = temporal.asof_join(events, _placed(spark, sf_dir), ["user_id"], "ts", "placed", ["o_orderkey", "placed"], tie=["o_orderkey"])
    return found.select("event_id", "user_id", "o_orderkey", "placed")


@register(
    "E_asof_view",
    """
    WITH v AS (SELECT user_id, ts AS viewed, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
    SELECT e.event_id, CASE WHEN v.viewed >= e.ts - INTERVAL 2 DAY THEN v.view_id END AS view_id
    FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts > v.viewed WHERE e.event_type = 'purchase'
    """,
)
def e_asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view before it, if that is no more than two days old."""
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    found = temporal.asof_join(bought, views, ["user_id"], "ts", "viewed", ["view_id"], tie=["view_id"], before=True, tolerance=2 * 86_400)
    return found.select("event_id", "view_id")


@register(
    "E_interval_pairs",
    """
    SELECT a.event_id AS a_id, b.event_id AS b_id, a.user_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR
    """,
)
def e_interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user within an hour of each other, each pair once."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    others = events.withColumnsRenamed({"a_id": "b_id", "a_ts": "b_ts"})
    return temporal.interval_join(events, others, ["user_id"], "a_ts", "b_ts", -3600, 3600).filter("a_id < b_id").select("a_id", "b_id", "user_id")


@register(
    "E_merge",
    """
    WITH s AS (
      SELECT o_custkey + CASE WHEN o_custkey % 7 = 0 THEN 10000000 ELSE 0 END AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS spent, count(*) AS n
      FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey
    ), j AS (
      SELECT *, CASE WHEN c_custkey IS NOT NULL AND k IS NOT NULL THEN CASE WHEN c_acctbal < 0 THEN 'delete' WHEN n > 5 THEN 'update' ELSE 'keep' END
                     WHEN k IS NOT NULL THEN CASE WHEN spent > 100000 THEN 'insert' END
                     WHEN c_mktsegment = 'MACHINERY' THEN 'delete' WHEN c_acctbal < 1000 THEN 'update' ELSE 'keep' END AS action
      FROM customer c FULL JOIN s ON c.c_custkey = s.k
    )
    SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN spent WHEN action = 'update' AND k IS NOT NULL THEN spent ELSE c_acctbal END AS c_acctbal,
           CASE WHEN action = 'update' AND k IS NULL THEN 'IDLE' ELSE c_mktsegment END AS c_mktsegment, action
    FROM j WHERE action IS NOT NULL
    """,
)
def e_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with what they have spent: poor ones deleted, busy ones updated, unknown rich ones inserted, idle ones marked or deleted."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    spent = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0").groupBy("o_custkey").agg(spent.alias("c_acctbal"), F.count("*").alias("n"))
    moved = F.col("o_custkey") + F.when(F.col("o_custkey") % 7 == 0, 10_000_000).otherwise(0)
    source = orders.select(moved.alias("c_custkey"), "c_acctbal", "n")
    return merging.merge_actions(
        customers,
        source,
        ["c_custkey"],
        matched=[(F.col("t.c_acctbal") < 0, merging.DELETE), (F.col("s.n") > 5, merging.UPDATE)],
        not_matched=[(F.col("s.c_acctbal") > 100_000, merging.INSERT)],
        not_matched_by_source=[(F.col("t.c_mktsegment") == "MACHINERY", merging.DELETE), (F.col("t.c_acctbal") < 1000, merging.UPDATE)],
        update={"c_acctbal": F.col("s.c_acctbal")},
        update_by_source={"c_mktsegment": F.lit("IDLE")},
    )


@register(
    "E_sketches",
    "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS distinct_within_bound, TRUE AS quantiles_within_bound FROM events GROUP BY event_type",
)
def e_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sketches of users and values by type, merged to the month: exact numbers, and whether the sketches' are within three standard
    errors (distinct users) and twice the stated rank error (median and 90th percentile)."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    folder = new_folder(spark, "sketches")
    sketches.sketch(events, ["event_type", "day"], "user_id", "value").write.parquet(folder)
    month = sketches.merge_sketches(spark.read.parquet(folder), ["event_type"])
    told = month.select(F.col("event_type").alias("kind"), sketches.distinct_count().alias("about"), sketches.quantile(0.5).alias("half"), sketches.quantile(0.9).alias("most"))
    met = events.join(F.broadcast(told), events.event_type == told.kind)  # a row for each event type
    exact = met.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.first("about").alias("about"),
        *[F.avg((F.col("value") <= F.col(c)).cast("double")).alias(c) for c in ("half", "most")],
    )
    near = F.abs(F.col("about") - F.col("users")) <= F.ceil(3 * sketches.DISTINCT_ERROR * F.col("users"))
    slack = 2 * sketches.RANK_ERROR + 1 / F.col("n")
    ranked = (F.abs(F.col("half") - 0.5) <= slack) & (F.abs(F.col("most") - 0.9) <= slack)
    return exact.select("event_type", "n", "users", near.alias("distinct_within_bound"), ranked.alias("quantiles_within_bound"))


_TOTALS = "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total"
_GROUPED = "(SELECT *, nullif(o_orderstatus, 'P') AS status, left(o_orderpriority, 1) AS priority, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a status that is null for some, so that subtotals and groups of nulls are both there."""
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.year(date).cast("long").alias("y"), F.month(date).cast("long").alias("m"), "o_totalprice"
    )


def _order_totals() -> list:
    return [F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")]


@register(
    "E_cube",
    f"""
    SELECT status, priority, CAST(GROUPING_ID(status, priority) AS BIGINT) AS grouping_id, array_to_string([x FOR x IN [CASE WHEN GROUPING(status) = 1 THEN 'status' END, CASE WHEN GROUPING(priority) = 1 THEN 'priority' END] IF x IS NOT NULL], ',') AS total_of,
           count(*) AS n, {_TOTALS} FROM {_GROUPED} GROUP BY CUBE (status, priority)
    """,
)
def e_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["status", "priority"]
    return grouping.subtotals(_grouped(spark, sf_dir), columns, grouping.cube_sets(columns), _order_totals())


@register(
    "E_rollup",
    f"""
    SELECT y, m, status, CAST(GROUPING_ID(y, m, status) AS BIGINT) AS grouping_id,
           CASE GROUPING_ID(y, m, status) WHEN 0 THEN '' WHEN 1 THEN 'status' WHEN 3 THEN 'm,status' ELSE 'y,m,status' END AS total_of, count(*) AS n, {_TOTALS}
    FROM {_GROUPED} GROUP BY ROLLUP (y, m, status)
    """,
)
def e_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["y", "m", "status"]
    return grouping.subtotals(_grouped(spark, sf_dir), columns, grouping.rollup_sets(columns), _order_totals())


@register(
    "E_grouping_sets",
    f"""
    SELECT y, status, priority, CAST(GROUPING_ID(y, status, priority) AS BIGINT) AS grouping_id,
           CASE GROUPING_ID(y, status, priority) WHEN 1 THEN 'priority' WHEN 6 THEN 'y,status' ELSE 'y,status,priority' END AS total_of, count(*) AS n, {_TOTALS}
    FROM {_GROUPED} GROUP BY GROUPING SETS ((y, status), (priority), ())
    """,
)
def e_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.subtotals(_grouped(spark, sf_dir), ["y", "status", "priority"], [["y", "status"], ["priority"], []], _order_totals())


@register(
    "E_moving_sums",
    """
    SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS week FROM events
    """,
)
def e_moving_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its type's sum over the seven days up to it; a type is a fifth of all events."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    return temporal.moving_sum(events, ["event_type"], "ts", "value", 7 * 86_400, "week").select("event_id", F.col("week").cast("double").alias("week"))


@register(
    "E_ranks",
    """
    SELECT event_id, row_number() OVER w AS row_number, rank() OVER (PARTITION BY event_type ORDER BY value) AS rank,
           percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS percent_rank, ntile(7) OVER w AS ntile
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)
    """,
)
def e_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's places among those of its type by value."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ranks.with_ranks(events, ["event_type"], "value", ["event_id"], 7, blocks=32).select("event_id", "row_number", "rank", "percent_rank", "ntile")


@register("O1_global_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position, rank() OVER (ORDER BY o_orderdate DESC) AS day_position FROM orders")
def o1_global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, newest first, with their position in the whole table's order; no task sees more than its block."""
    place = -F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"))
    ranked = ranks.with_ranks(orders, [], "place", ["o_orderkey"], 1, blocks=32)
    return ranked.select("o_orderkey", F.col("row_number").alias("position"), F.col("rank").alias("day_position"))


_HALF = "TIMESTAMP '2024-01-16'"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Who did what in the first and in the second half of the month; a null stands for sign-ups."""
    rows = table(spark, sf_dir, "events").select("ts", "user_id", F.nullif("event_type", F.lit("signup")).alias("kind"))
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return rows.filter(first).drop("ts"), rows.filter(~first).drop("ts")


_FIRST, _SECOND = (f"SELECT user_id, nullif(event_type, 'signup') AS kind FROM events WHERE ts {c} {_HALF}" for c in ("<", ">="))


@register("E_intersect_all", f"{_FIRST} INTERSECT ALL {_SECOND}")
def e_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.intersect_all(*_halves(spark, sf_dir))


@register("E_except_all", f"{_FIRST} EXCEPT ALL {_SECOND}")
def e_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.except_all(*_halves(spark, sf_dir))


@register(
    "E_snapshot_difference",
    f"""
    SELECT user_id, kind, CAST(sum(n) AS BIGINT) AS change FROM (SELECT *, -1 AS n FROM ({_FIRST}) UNION ALL SELECT *, 1 AS n FROM ({_SECOND}))
    GROUP BY user_id, kind HAVING sum(n) <> 0
    """,
)
def e_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multisets.difference(*_halves(spark, sf_dir))


_PAGE = "SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders"


def _paged(spark: SparkSession, sf_dir: str) -> PagedTable:
    """Orders, newest first."""
    newest_first = -F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", newest_first.alias("place"))
    return PagedTable(spark, new_folder(spark, "pages"), ["place", "o_orderkey"]).build(orders, 16)


@register("E_page", f"SELECT * FROM ({_PAGE}) WHERE position BETWEEN 350 AND 399")
def e_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth page of fifty orders, by the directory."""
    return _paged(spark, sf_dir).page(7, 50).drop("place")


@register("E_page_after", f"SELECT * FROM ({_PAGE}) WHERE position BETWEEN 1000 AND 1099")
def e_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred orders after the last one of the tenth page of a hundred, by that order's key."""
    pages = _paged(spark, sf_dir)
    last = pages.page(9, 100).filter("position = 999").first()
    return pages.after([last.place, last.o_orderkey], 100).drop("place")


@register(
    "E_stratified_sample",
    """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS place FROM orders)
    SELECT o_orderkey, o_orderstatus, o_orderpriority FROM s WHERE place <= 20
    """,
)
def e_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty orders of each status and priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return samples.stratified_sample(orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 20, "7")
