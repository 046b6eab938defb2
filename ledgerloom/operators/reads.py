"""Scoped reads: lookups, filters, ordered and limited lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, **equal: object) -> DataFrame:
    """Rows where every named column has the given value; pushed down to the scan."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def exactly_one(df: DataFrame) -> DataFrame:
    """df, read by a unique key: its one row, or an error while it runs where there is none or more."""
    two = df.limit(2).agg(F.collect_list(F.struct("*")).alias("rows"))
    one = F.when(F.size("rows") == 1, F.col("rows")[0]).otherwise(F.raise_error(F.lit("expected exactly one row")))
    return two.select(one.alias("row")).select("row.*")


def recent(df: DataFrame, ts: str, anchor: Column, hours: int = 24) -> DataFrame:
    """Rows from the hours before anchor on, the boundary included."""
    return df.filter(F.col(ts) >= anchor - F.expr(f"INTERVAL {int(hours)} HOURS"))


def expired(expires_at: Column, now: Column) -> Column:
    """At its very time a thing has expired."""
    return expires_at <= now


def newest(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows under a total order, as one top-k rather than a sort."""
    return df.orderBy(*order).limit(limit)


def page(df: DataFrame, limit: int | None, *order: Column, default: int = 50, most: int = 200) -> DataFrame:
    """As newest, with a caller's limit: default if none, at most `most`; below 1 or not whole is refused."""
    wanted = default if limit is None else limit
    if isinstance(wanted, bool) or not isinstance(wanted, int) or wanted < 1:
        raise ValueError(f"limit must be a whole number from 1, not {limit!r}")
    return newest(df, min(wanted, most), *order)


def any_match(df: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """Per key, whether some row meets the condition."""
    return df.groupBy(key).agg(F.bool_or(F.coalesce(condition, F.lit(False))).alias(name))
