"""Table changes as functions from the old rows to the new ones, to be written beside or over the old table.

Several tables can't be changed at once this way: a change of two tables is two writes, and a reader between them sees one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_by_key(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the columns of changes (one row a key) set where the key matches; a null in changes is set too."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__set"))
    joined = old.join(new, old[key] == new["__k"], "left")
    return joined.select(*[F.when(F.col("__set"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def delete_matching(old: DataFrame, condition: Column) -> DataFrame:
    """old without the rows for which the condition is true; where it is null they stay."""
    return old.filter(~F.coalesce(condition, F.lit(False)))


def delete_by_key(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def insert(old: DataFrame, rows: DataFrame) -> DataFrame:
    return old.unionByName(rows, allowMissingColumns=True)


def insert_missing(old: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Get or create: old and those of wanted whose key it lacks."""
    return insert(old, wanted.join(old.select(key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """All children of parents replaced by new; doing it again changes nothing."""
    return insert(delete_by_key(old, parents, parent_key), new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows replace old's of the same key; others are added or stay."""
    return insert(delete_by_key(old, new, key), new)


def upsert_draft(old: DataFrame, results: DataFrame, placeholder: str) -> DataFrame:
    """Drafts (id, body, model, error) after results (id, body, model, error).

    A success replaces everything. A failure keeps an old body and model and sets the error; without an old draft it writes the placeholder.
    """
    o, n = old.alias("o"), results.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, "id", "full_outer")
    failed = F.col("n.error").isNotNull()
    new = F.coalesce(F.col("n.__new"), F.lit(False))
    first_body = F.coalesce(F.col("o.body"), F.lit(placeholder))
    return joined.select(
        "id",
        F.when(new & ~failed, F.col("n.body")).when(new, first_body).otherwise(F.col("o.body")).alias("body"),
        F.when(new & ~failed, F.col("n.model")).otherwise(F.col("o.model")).alias("model"),
        F.when(new, F.col("n.error")).otherwise(F.col("o.error")).alias("error"),
    )


def audit_event(actor: Column, action: str, target_type: Column, target_id: Column, meta: Column, at: Column) -> list[Column]:
    """The columns of an audit row; meta is kept as JSON."""
    return [
        actor.alias("actor_user_id"),
        F.lit(action).alias("action"),
        F.lit(target_type).alias("target_type"),
        target_id.alias("target_id"),
        F.to_json(meta).alias("meta"),
        at.alias("created_at"),
    ]
