"""Usage per calendar month, and limits by plan."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.functions.text import year_month

#: Monthly limits by plan as (analyses, drafts), and the settings that replace them.
LIMITS = {"demo": (20, 10), "starter": (500, 200)}
SETTINGS = {
    "demo": ("BILLING_DEMO_AI_PER_MONTH", "BILLING_DEMO_DRAFT_PER_MONTH"),
    "starter": ("BILLING_STARTER_AI_PER_MONTH", "BILLING_STARTER_DRAFT_PER_MONTH"),
}


def plan_limits(settings: Mapping[str, str] = os.environ) -> dict[str, tuple[int, int]]:
    """Limits with settings applied; 0 is a limit, anything that doesn't start with a whole number from 0 is ignored."""

    def read(name: str, default: int) -> int:
        found = re.match(r"\s*[+-]?\d+", settings.get(name) or "")
        return int(found[0]) if found and int(found[0]) >= 0 else default

    return {plan: tuple(read(n, d) for n, d in zip(SETTINGS[plan], LIMITS[plan], strict=True)) for plan in LIMITS}


def monthly_usage(events: DataFrame, owner: str, ts: str, measures: dict[str, Column]) -> DataFrame:
    """(owner, year_month, one count per measure) of events; months are UTC calendar months."""
    return events.groupBy(owner, year_month(F.col(ts)).alias("year_month")).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])


def add_usage(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Counters with increments added; keys new to either side start from 0."""
    o, n = old.select(*keys, *counts).alias("o"), new.select(*keys, *counts).alias("n")
    joined = o.join(n, keys, "full_outer")
    return joined.select(*keys, *[(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))).alias(c) for c in counts])


def with_plan(owners: DataFrame, subscriptions: DataFrame, key: str, default: str = "demo") -> DataFrame:
    """Each owner with its plan; one without a subscription has the default, and nothing is written."""
    plans = subscriptions.select(F.col(key).alias("__k"), F.col("plan_code").alias("__p"))
    joined = owners.join(plans, owners[key] == plans["__k"], "left")
    return joined.withColumn("plan_code", F.coalesce("__p", F.lit(default))).drop("__k", "__p")


def gate(usage: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """usage (plan_code, ai_analyze_count, draft_gen_count, ...) with its limits, and whether each is used up."""
    table = limits or LIMITS
    pick = lambda i: F.coalesce(*[F.when(F.col("plan_code") == p, v[i]) for p, v in table.items()])
    limited = usage.withColumns({"ai_limit": pick(0), "draft_limit": pick(1)})
    return limited.withColumns({"ai_blocked": F.col("ai_analyze_count") >= F.col("ai_limit"), "draft_blocked": F.col("draft_gen_count") >= F.col("draft_limit")})


#: The figures of observed calls, in their order.
FIGURES = ("calls", "tokens_in", "tokens_out", "slowest_ms")


def observed_calls(calls: DataFrame) -> tuple[DataFrame, Observation]:
    """calls (tokens_in, tokens_out, elapsed_ms, ...) as they are, and their figures, known once calls have been written or collected."""
    figures = Observation()
    sums = [F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")]
    return calls.observe(figures, *sums, F.max("elapsed_ms").alias("slowest_ms")), figures
