"""Subtotals: several groupings of one table in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_sets(columns: Sequence[str]) -> list[list[str]]:
    """All columns, then one less from the right, down to none."""
    return [list(columns[:n]) for n in range(len(columns), -1, -1)]


def cube_sets(columns: Sequence[str]) -> list[list[str]]:
    """Every subset of the columns."""
    return [list(c) for n in range(len(columns), -1, -1) for c in combinations(columns, n)]


def subtotals(rows: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """(columns, grouping_id, total_of, aggregates) of each grouping set.

    grouping_id has a bit for each column, the first one highest, set where the row is a total over it; total_of names those columns. So a
    subtotal's null isn't taken for a group whose value is null.
    """
    names = F.array_compact(F.array(*[F.when(F.grouping(c) == 1, F.lit(c)) for c in columns]))
    told = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return told.agg(F.grouping_id().cast("long").alias("grouping_id"), F.array_join(names, ",").alias("total_of"), *aggregates)
