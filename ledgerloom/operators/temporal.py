"""Joins and sums along time, for keys of any size.

Time is cut into buckets, and rows meet by key and bucket, so a key with a third of all rows is spread over its buckets. What a bucket needs
from those before it is one row a bucket (a carry), summed or looked up over the key's buckets alone. A bucket of one key is one task's
work; its width is the caller's. Times are timestamps with or without zone, compared by the microsecond.

Rows whose key or time is null meet nothing; of the left side they stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY = 86_400


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _bucket(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000))


def _whole(by: Sequence[str], time: str) -> Column:
    """Whether a row has a key and a time."""
    told = F.col(time).isNotNull()
    for c in by:
        told = told & F.col(c).isNotNull()
    return told


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    before: bool = False,
    tolerance: int | None = None,
    bucket: int = _DAY,
) -> DataFrame:
    """left with columns of the newest row of right that has its key and isn't later (before: is earlier) than it.

    Of right rows of one time the greatest by tie counts. tolerance is the greatest age in seconds. Without such a row the columns are null.
    """
    clash = set(columns) & set(left.columns)
    if clash:
        raise ValueError(f"left has columns of these names already: {sorted(clash)}")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    hit = F.struct(F.struct(*columns).alias("found"), _micros(right_time).alias("at"))
    hits = right.filter(_whole(by, right_time)).select(*keys, _micros(right_time).alias("t"), F.lit(2 if before else 0).alias("side"), F.struct(F.lit(0), *tie).alias("tie"), hit.alias("hit"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row")
    asked = left.filter(_whole(by, left_time)).select(*keys, _micros(left_time).alias("t"), F.lit(1).alias("side"), row)
    both = asked.unionByName(hits, allowMissingColumns=True).withColumn("bucket", _bucket(F.col("t"), bucket))

    inside = Window.partitionBy(*names, "bucket").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.last("hit", ignorenulls=True).over(inside)).filter("side = 1").select(*names, "bucket", "t", "row", "near")
    newest = both.groupBy(*names, "bucket").agg(F.max_by("hit", F.when(F.col("side") != 1, F.struct("t", "tie"))).alias("own"))
    earlier = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*names, "bucket", F.last("own", ignorenulls=True).over(earlier).alias("carry"))
    met = near.join(carried, [*names, "bucket"], "left").withColumn("hit", F.coalesce("near", "carry"))
    if tolerance is not None:
        met = met.withColumn("hit", F.when(F.col("t") - F.col("hit.at") <= tolerance * 1_000_000, F.col("hit")))
    found = met.select("row.*", *[F.col(f"hit.found.{c}").alias(c) for c in columns])
    types = {f.name: f.dataType for f in found.schema}
    alone = left.filter(~_whole(by, left_time)).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    return found.unionByName(alone)


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, lower: int, upper: int) -> DataFrame:
    """All pairs of one key with right_time from lower to upper seconds after left_time, both ends included; each pair once.

    Buckets are as wide as the interval: a left row looks into the two that its interval can touch, a right row is in one. Pairs of a bucket
    are tested exactly. Other columns of the two sides must have different names.
    """
    clash = set(left.columns) & set(right.columns) - set(by)
    if clash or lower > upper:
        raise ValueError(f"both sides have {sorted(clash)}" if clash else "the interval is empty")
    width = max(upper - lower, 1)
    first, last = (_bucket(_micros(left_time) + edge * 1_000_000, width) for edge in (lower, upper))
    asked = left.filter(_whole(by, left_time)).withColumns({"__at": _micros(left_time), "__bucket": F.explode(F.sequence(first, last))})
    there = right.filter(_whole(by, right_time)).withColumns({"__t": _micros(right_time), "__bucket": _bucket(_micros(right_time), width)})
    inside = (F.col("__t") - F.col("__at")).between(lower * 1_000_000, upper * 1_000_000)
    return asked.join(there, [*by, "__bucket"]).filter(inside).drop("__at", "__t", "__bucket")


def running_sum(rows: DataFrame, by: Sequence[str], time: str, value: str, name: str, bucket: int = _DAY) -> DataFrame:
    """rows with the sum of their key's values up to and including their time, rows of the same time included."""
    at = _micros(time)
    told = rows.filter(_whole(by, time)).withColumns({"__t": at, "__bucket": _bucket(at, bucket)})
    inside = Window.partitionBy(*by, "__bucket").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = told.groupBy(*by, "__bucket").agg(F.sum(value).alias("__sum"))
    carried = totals.select(*by, "__bucket", F.sum("__sum").over(earlier).alias("__carry"))
    summed = told.withColumn("__in", F.sum(value).over(inside)).join(carried, [*by, "__bucket"])
    total = F.coalesce("__in", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    return summed.withColumn(name, total).select(*rows.columns, name)


def moving_sum(rows: DataFrame, by: Sequence[str], time: str, value: str, seconds: int, name: str, bucket: int = _DAY) -> DataFrame:
    """rows with the sum of their key's values of the last seconds before their time, both ends included: a frame by range of time.

    It is the running sum less the running sum just before the frame, looked up by an as-of join; so no frame is walked through, and value
    should be an integer or a decimal, whose sums are exact. Rows without a key or time get null, null values count as nothing.
    """
    summed = running_sum(rows, by, time, value, "__upto", bucket)
    marks = summed.select(*by, F.col(time).alias("__mark"), F.col("__upto").alias("__earlier")).distinct()
    framed = summed.withColumn("__from", F.col(time).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))
    met = asof_join(framed, marks, by, "__from", "__mark", ["__earlier"], before=True, bucket=bucket)
    told = met.withColumn(name, F.col("__upto") - F.coalesce("__earlier", F.lit(0))).select(*rows.columns, name)
    return told.unionByName(rows.filter(~_whole(by, time)), allowMissingColumns=True)
