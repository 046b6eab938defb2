"""Narrow rows to plan with, and the way back from them to whole rows.

Plans need a few numbers of each row, never its text. Rows are told by a key: the text's hash, doc_id, and a hash of doc_id and source.
Rows with one key are interchangeable in a plan, so they are one narrow row with their number n, and take consecutive places. A finished
plan (a row for each key) meets the whole rows once, in a hash join that builds on the plan's side: texts are moved once, and only rows
that share a key are sorted by it, to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written

KEY = ["k_text", "k_doc", "k_rest"]


def _key() -> list[Column]:
    doc = F.col("doc_id").cast("long")
    return [F.xxhash64("text").alias(KEY[0]), F.coalesce(doc, F.lit(-1)).alias(KEY[1]), F.xxhash64(doc, "source").alias(KEY[2])]


def narrow(docs: DataFrame, measures: dict[str, Column], name: str) -> DataFrame:
    """(key, doc_id, source, measures, n) of each key; measures must follow from the key. Written to the shared folder."""
    told = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source")} | measures
    rows = docs.select(*_key(), *[c.alias(m) for m, c in told.items()])
    return written(rows.groupBy(*KEY).agg(*[F.first(m).alias(m) for m in told], F.count("*").alias("n")), name)


def copies(plan: DataFrame) -> DataFrame:
    """plan with a row for each of its n rows, numbered by copy from 0."""
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def whole(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (key, n, ...) with a row for each row of docs of a planned key: the whole row as the struct `row`, and its copy.

    Rows that share a key take their copies in the order of a hash of all their columns.
    """
    side = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key())
    kept = [*plan.columns, "row", "copy"]
    single = side.join(plan.filter("n = 1").hint("shuffle_hash"), KEY).withColumn("copy", F.lit(0).cast("long")).select(*kept)
    several = plan.filter("n > 1")
    if several.isEmpty():
        return single
    order = Window.partitionBy(*KEY).orderBy("__h")
    met = side.join(several.hint("shuffle_hash"), KEY).withColumn("__h", F.xxhash64(F.to_json("row")))
    return single.unionByName(met.withColumn("copy", F.row_number().over(order).cast("long") - 1).select(*kept))
