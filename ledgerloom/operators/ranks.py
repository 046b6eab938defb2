"""Ranks over keys of any size, in two levels: the rows of blocks before a row's block, and the row's place in its block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import new_folder


def range_blocks(rows: DataFrame, order: Sequence[str], blocks: int, name: str) -> DataFrame:
    """rows with their block: ranges of the order, numbered along it, written so that they stay what they are."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, name)
    ranged = rows.repartitionByRange(blocks, *order).withColumn("__block", F.spark_partition_id())
    ranged.write.parquet(folder)
    return spark.read.schema(ranged.schema).parquet(folder)


def with_ranks(rows: DataFrame, by: Sequence[str], value: str, tie: Sequence[str], tiles: int, blocks: int = 200) -> DataFrame:
    """rows with row_number, rank, percent_rank and ntile among their key's, by value (nulls first) and then tie, which must be total.

    Rows are dealt by range of (key, value, tie), so a key of any size is spread over blocks; equal values of one key share a rank, which is
    the row number of their first.
    """
    parted = range_blocks(rows, [*by, value, *tie], blocks, "rank-blocks")
    inside = Window.partitionBy(*by, "__block").orderBy(value, *tie)
    sizes = parted.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*by, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__all"))
    placed = parted.withColumn("__at", F.row_number().over(inside))
    numbered = _join_null_safe(placed, carried, [*by, "__block"]).withColumn("row_number", F.col("__before") + F.col("__at"))
    firsts = numbered.groupBy(*by, value).agg(F.min("row_number").alias("rank"))
    ranked = _join_null_safe(numbered, firsts, [*by, value])
    all_rows, at = F.col("__all"), F.col("row_number")
    # The first __all % tiles tiles have a row more than the others.
    small, large = F.floor(all_rows / tiles), all_rows % tiles
    in_large = at <= large * (small + 1)
    tile = F.when(in_large, F.floor((at - 1) / (small + 1)) + 1).otherwise(large + F.floor((at - large * (small + 1) - 1) / F.greatest(small, F.lit(1))) + 1)
    percent = F.when(all_rows > 1, (F.col("rank") - 1) / (all_rows - 1)).otherwise(F.lit(0.0))
    return ranked.select(*rows.columns, "row_number", "rank", percent.alias("percent_rank"), tile.cast("long").alias("ntile"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(renamed[f"__r_{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, same).drop(*[f"__r_{i}" for i in range(len(keys))])
