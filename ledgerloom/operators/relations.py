"""Relation operators: scoped reads, counts of children, nested children and newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Each parent row with its number of children; childless parents get 0.

    Children are counted before the join, so counts of several child tables never multiply each other.
    """
    counts = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias("__n"))
    joined = parent.join(counts, parent[parent_key] == counts["__k"], "left")
    return joined.withColumn(name, F.coalesce("__n", F.lit(0).cast("long"))).drop("__k", "__n")


def with_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, order: list[str], name: str) -> DataFrame:
    """Each parent row with the array of its children, sorted by order; [] where there are none."""
    fields = order + [c for c in child.columns if c not in order and c != child_key]
    nested = child.groupBy(F.col(child_key).alias("__k")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parent.join(nested, parent[parent_key] == nested["__k"], "left").drop("__k")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def first_per_key(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order; Spark prunes to one row a key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn")


def latest_child(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, order: list[Column]) -> DataFrame:
    """Each parent with its first child under order, or nulls; no parent is lost."""
    top = first_per_key(child, child_key, order)
    return parent.join(top, parent[parent_key] == top[child_key], "left")


def with_next_number(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, number: str, name: str) -> DataFrame:
    """Each parent row with the number its next child gets: the highest so far plus one, 1 where there is none."""
    highest = child.groupBy(F.col(child_key).alias("__k")).agg(F.max(number).alias("__n"))
    joined = parent.join(highest, parent[parent_key] == highest["__k"], "left")
    return joined.withColumn(name, F.coalesce("__n", F.lit(0)) + 1).drop("__k", "__n")
