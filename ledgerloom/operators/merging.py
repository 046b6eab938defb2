"""MERGE: one pass over a target and a source, told by an action code for each row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, UPDATE, DELETE, INSERT = "keep", "update", "delete", "insert"
#: A clause: its condition (true where None) and its action.
Clause = tuple[Column | None, str]


def _chosen(clauses: Sequence[Clause], otherwise: str) -> Column:
    """The action of the first clause whose condition is true."""
    told = F.lit(otherwise)
    for condition, action in reversed(clauses):
        told = F.when(F.lit(True) if condition is None else F.coalesce(condition, F.lit(False)), action).otherwise(told)
    return told


def merge_actions(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    matched: Sequence[Clause] = (),
    not_matched: Sequence[Clause] = ((None, INSERT),),
    not_matched_by_source: Sequence[Clause] = (),
    update: Mapping[str, Column] | None = None,
    update_by_source: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The target's columns and `action`, a row for each target row and each inserted source row, deleted ones included.

    Conditions and values name the sides as t and s (`F.col("t.price")`). matched clauses update (to `update`, by default all columns that
    both sides have) or delete; not_matched ones insert, source columns by name, others null; not_matched_by_source ones update (to
    `update_by_source`) or delete. Rows without an action are kept, or not inserted. A null key matches nothing. Where there are matched clauses, a
    target row that meets two source rows is an error, raised when the rows are computed; two source rows that meet none are both inserted.
    """
    values = {c: F.col(f"s.{c}") for c in target.columns if c in source.columns} if update is None else dict(update)
    values_by_source = dict(update_by_source or {})
    many = source.groupBy(*keys).agg(F.count("*").alias("__many")).filter("__many > 1")
    told = source.join(many, list(keys), "left").withColumn("__s", F.lit(True))
    if not matched:  # source rows that meet a target row do nothing, so one of a key tells enough
        fresh = told.join(target.select(*keys).distinct(), list(keys), "left_anti")
        known = source.select(*keys).distinct().withColumn("__s", F.lit(True)).join(target.select(*keys).distinct(), list(keys), "left_semi")
        told = fresh.unionByName(known, allowMissingColumns=True)
    same = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    both = target.withColumn("__t", F.lit(True)).alias("t").join(told.alias("s"), same, "full_outer")
    in_target, in_source = F.col("__t").isNotNull(), F.col("__s").isNotNull()
    code = (
        F.when(in_target & in_source, _chosen(matched, KEEP))
        .when(in_source, _chosen(not_matched, KEEP))
        .otherwise(_chosen(not_matched_by_source, KEEP))
    )
    rows = both.withColumns({"__code": code, "__met": in_target & in_source, "__new": ~in_target}).filter(in_target | (code == INSERT))
    message = F.concat(F.lit("more than one source row matches the target row "), F.to_json(F.struct(*[F.col(f"t.{k}").alias(k) for k in keys])))
    action = F.when(F.col("__met") & (F.col("__many") > 1), F.raise_error(message)).otherwise(F.col("__code"))

    def value(c: str) -> Column:
        own, kind, changed = F.col(f"t.{c}"), target.schema[c].dataType, F.col("__code") == UPDATE
        out = F.when(F.col("__new"), (F.col(f"s.{c}") if c in source.columns else F.lit(None)).cast(kind))
        if c in values:
            out = out.when(changed & F.col("__met"), values[c].cast(kind))
        if c in values_by_source:
            out = out.when(changed & ~F.col("__met"), values_by_source[c].cast(kind))
        return out.otherwise(own).alias(c)

    return rows.select(*[value(c) for c in target.columns], action.alias("action"))


def merged(actions: DataFrame) -> DataFrame:
    """The target after a merge."""
    return actions.filter(F.col("action") != DELETE).drop("action")


def merge_counts(actions: DataFrame) -> DataFrame:
    """(action, n): how many rows each action met."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))
