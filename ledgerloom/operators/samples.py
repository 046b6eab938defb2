"""Samples of a fixed size for each stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, strata: Sequence[str], ids: Sequence[str], size: int, seed: str) -> DataFrame:
    """The size rows of each stratum with the smallest hash of seed and ids: the same for any partitioning, and for any part of the strata.

    Every task keeps at most size rows a stratum before anything is shuffled (a window's group limit), so a stratum of any size costs no
    more than the tasks that hold it. Null ids hash as empty texts; equal hashes are told apart by the ids.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    drawn = rows.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(seed), *told), 256))
    order = Window.partitionBy(*strata).orderBy("__h", *ids)
    return drawn.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= size).drop("__h", "__place")
