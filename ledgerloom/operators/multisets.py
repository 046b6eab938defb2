"""Set operations by multiplicity: counts of both sides in one aggregate, so a row that repeats is one row until it is wanted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEFT, _RIGHT = "__n_left", "__n_right"


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of both sides (columns by position, nulls equal) with how often each side has them."""
    names, kinds = left.columns, [f.dataType for f in left.schema]
    other = right.select(*[F.col(f"`{c}`").cast(k).alias(n) for c, k, n in zip(right.columns, kinds, names, strict=True)])
    sides = left.withColumns({_LEFT: F.lit(1), _RIGHT: F.lit(0)}).union(other.withColumns({_LEFT: F.lit(0), _RIGHT: F.lit(1)}))
    return sides.groupBy(*names).agg(F.sum(_LEFT).alias(_LEFT), F.sum(_RIGHT).alias(_RIGHT))


def copies(rows: DataFrame, n: str) -> DataFrame:
    """Each row n times, its column n left out. A row repeated very often is first dealt into thousands."""
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / 1000)))
    parts = rows.filter(F.col(n) > 0).withColumn("__part", some).hint("rebalance")
    size = F.least(F.lit(1000), F.col(n) - F.col("__part") * 1000)
    return parts.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long")))).drop("__part", "__copy", n)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, as often as the side has them that has them less."""
    told = counted(left, right).withColumn("__n", F.least(_LEFT, _RIGHT))
    return copies(told.select(*left.columns, "__n"), "__n")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, as often as left has them more than right."""
    told = counted(left, right).withColumn("__n", F.col(_LEFT) - F.col(_RIGHT))
    return copies(told.select(*left.columns, "__n"), "__n")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that two snapshots have unequally often, and `change`: by how much right has them more (negative: less)."""
    return counted(left, right).withColumn("change", F.col(_RIGHT) - F.col(_LEFT)).filter("change <> 0").select(*left.columns, "change")
