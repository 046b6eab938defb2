"""Operators beyond the reference's own, against brute force on small tables with nulls, ties, repeats and a hot key."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import grouping, merging, multisets, ranks, samples, sketches, temporal
from ledgerloom.operators.pages import PagedTable

START = dt.datetime(2024, 1, 1)
EVENT = "id int, k string, at timestamp_ntz, v decimal(10,2)"


def events(n, seed, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        at = None if rng.random() < 0.05 else START + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 6, 30))
        rows.append((i, k, at, None if rng.random() < 0.1 else Decimal(rng.randrange(-500, 500)).scaleb(-2)))
    return rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3600])
def test_asof_join(spark, before, tolerance):
    left, right = events(300, 1), events(200, 2)
    met = temporal.asof_join(
        spark.createDataFrame(left, EVENT),
        spark.createDataFrame(right, EVENT).select(F.col("k"), F.col("at").alias("r_at"), F.col("id").alias("r_id"), F.col("v").alias("r_v")),
        ["k"], "at", "r_at", ["r_id", "r_v", "r_at"], tie=["r_id"], before=before, tolerance=tolerance,
    )
    expected = []
    for i, k, at, v in left:
        fits = [r for r in right if None not in (k, at, r[1], r[2]) and r[1] == k and (r[2] < at if before else r[2] <= at)]
        best = max(fits, key=lambda r: (r[2], r[0]), default=None)
        if best and tolerance is not None and (at - best[2]).total_seconds() > tolerance:
            best = None
        expected.append((i, k, at, v, *((best[0], best[3], best[2]) if best else (None, None, None))))
    assert sorted(map(str, map(tuple, met.collect()))) == sorted(map(str, expected))
    assert "Cartesian" not in plan_of(met) and "NestedLoop" not in plan_of(met)


def test_asof_join_with_an_empty_side_and_clashing_names(spark):
    left, right = spark.createDataFrame(events(20, 3), EVENT), spark.createDataFrame([], "k string, t timestamp_ntz, x int")
    assert {r.x for r in temporal.asof_join(left, right, ["k"], "at", "t", ["x"]).collect()} == {None}
    assert temporal.asof_join(left.filter("false"), right, ["k"], "at", "t", ["x"]).count() == 0
    named = left.select("*", F.lit(1).alias("hit"), F.lit(2).alias("bucket"), F.lit(3).alias("side"), F.lit(4).alias("row"), F.lit(5).alias("k0"))
    assert temporal.asof_join(named, right, ["k"], "at", "t", ["x"]).columns == [*named.columns, "x"]
    with pytest.raises(ValueError):
        temporal.asof_join(left, right.withColumn("v", F.lit(1)), ["k"], "at", "t", ["v"])


@pytest.mark.parametrize(("lower", "upper"), [(-3600, 3600), (0, 0), (1800, 7200), (-7200, -1800)])
def test_interval_join(spark, lower, upper):
    left, right = events(120, 4), events(120, 5)
    other = spark.createDataFrame(right, EVENT).select("k", F.col("at").alias("r_at"), F.col("id").alias("r_id"))
    met = temporal.interval_join(spark.createDataFrame(left, EVENT), other, ["k"], "at", "r_at", lower, upper)
    expected = [(a[0], b[0]) for a in left for b in right if None not in (a[1], a[2], b[2]) and a[1] == b[1] and lower <= (b[2] - a[2]).total_seconds() <= upper]
    assert sorted((r.id, r.r_id) for r in met.collect()) == sorted(expected) and expected
    with pytest.raises(ValueError):
        temporal.interval_join(other, other, ["k"], "r_at", "r_at", lower, upper)


@pytest.mark.parametrize("seconds", [0, 5400, 2 * 86_400])
def test_running_and_moving_sums(spark, seconds):
    rows = events(250, 6)
    df = spark.createDataFrame(rows, EVENT)
    running = {r.id: r.total for r in temporal.running_sum(df, ["k"], "at", "v", "total").collect()}
    moving = {r.id: r.total for r in temporal.moving_sum(df, ["k"], "at", "v", seconds, "total").collect()}
    assert len(moving) == len(rows)
    for i, k, at, _ in rows:
        if k is None or at is None:
            assert i not in running and moving[i] is None
            continue
        own = [(r[2], r[3] or 0) for r in rows if r[1] == k and r[2] is not None]
        assert running[i] == sum(v for t, v in own if t <= at)
        assert moving[i] == sum(v for t, v in own if at - dt.timedelta(seconds=seconds) <= t <= at)


def test_ranks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "a", None, "one"][: 4 if i else 5]), rng.choice([None, 1, 1, 2, 3, 5])) for i in range(400)] + [(900, "lone", 4)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    found = {r.id: (r.row_number, r.rank, round(r.percent_rank, 9), r.ntile) for r in ranks.with_ranks(df, ["k"], "v", ["id"], 7, blocks=5).collect()}
    for k in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        small, large = divmod(len(own), 7)
        tiles = [t + 1 for t in range(7) for _ in range(small + (t < large))]
        for n, (i, _, v) in enumerate(own):
            rank = 1 + next(j for j, r in enumerate(own) if r[2] == v)
            assert found[i] == (n + 1, rank, round((rank - 1) / (len(own) - 1), 9) if len(own) > 1 else 0.0, tiles[n])
    assert ranks.with_ranks(df.filter("false"), ["k"], "v", ["id"], 7, blocks=5).count() == 0


def test_multisets(spark):
    rng = random.Random(8)
    sides = [[(rng.choice([1, 2, None]), rng.choice(["x", None])) for _ in range(n)] + [(9, "hot")] * m for n, m in ((40, 2500), (30, 1200))]
    left, right = (spark.createDataFrame(s, "a int, b string") for s in sides)
    one, two = map(Counter, sides)
    assert Counter(map(tuple, multisets.intersect_all(left, right).collect())) == one & two
    assert Counter(map(tuple, multisets.except_all(left, right).collect())) == one - two
    changes = {(r.a, r.b): r.change for r in multisets.difference(left, right).collect()}
    assert changes == {k: two[k] - one[k] for k in one.keys() | two.keys() if two[k] != one[k]}
    assert multisets.except_all(left.filter("false"), right).count() == 0 and multisets.intersect_all(left, right.filter("false")).count() == 0


TARGET = [(1, "a", 10), (2, "b", 20), (3, "c", 30), (None, "n", 40), (5, "e", 50), (5, "f", 60)]


def merge(spark, source, **clauses):
    df = merging.merge_actions(spark.createDataFrame(TARGET, "k int, name string, v int"), spark.createDataFrame(source, "k int, v int, more string"), ["k"], **clauses)
    return sorted((r.k or 0, r.name or "", r.v or 0, r.action) for r in df.collect())


def test_merge_clauses(spark):
    source = [(1, 100, "up"), (2, 200, "gone"), (3, None, "none"), (5, 500, "up"), (7, 700, "new"), (7, 701, "new"), (8, 800, "no"), (None, 900, "new")]
    got = merge(
        spark,
        source,
        matched=[(F.col("s.more") == "gone", merging.DELETE), (F.col("s.more") == "up", merging.UPDATE)],
        not_matched=[(F.col("s.more") == "new", merging.INSERT)],
        not_matched_by_source=[(F.col("t.v") == 40, merging.UPDATE)],
        update_by_source={"name": F.concat("t.name", F.lit("!"))},
    )
    assert got == [
        (0, "", 900, "insert"), (0, "n!", 40, "update"), (1, "a", 100, "update"), (2, "b", 20, "delete"), (3, "c", 30, "keep"),
        (5, "e", 500, "update"), (5, "f", 500, "update"), (7, "", 700, "insert"), (7, "", 701, "insert"),
    ]


def test_merge_meets_two_source_rows(spark):
    twice = [(1, 100, "x"), (1, 101, "x")]
    with pytest.raises(Exception, match="more than one source row"):
        merge(spark, twice, matched=[(None, merging.UPDATE)])
    # Without matched clauses nothing is changed twice, so that's no error, and the target row is there once.
    assert merge(spark, [*twice, (7, 1, "y"), (7, 2, "y")])[:2] == [(0, "n", 40, "keep"), (1, "a", 10, "keep")]
    assert len(merge(spark, [*twice, (7, 1, "y"), (7, 2, "y")])) == len(TARGET) + 2


def test_merged_and_counts(spark):
    df = merging.merge_actions(
        spark.createDataFrame(TARGET, "k int, name string, v int"), spark.createDataFrame([], "k int, v int"), ["k"], not_matched_by_source=[(F.col("t.k") == 5, merging.DELETE)]
    )
    assert merging.merged(df).count() == 4 and {r.action: r.n for r in merging.merge_counts(df).collect()} == {"keep": 4, "delete": 2}


def test_pages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1, 2, 3, 4])) for i in range(500)]
    pages = PagedTable(spark, f"{tmp_path}/p", ["v", "id"]).build(spark.createDataFrame(rows, "id int, v int").repartition(7), 9)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for number, size in ((0, 10), (3, 33), (9, 50), (10, 50), (0, 1000)):
        got = pages.page(number, size).collect()
        assert [(r.id, r.v) for r in got] == ordered[number * size : (number + 1) * size] and [r.position for r in got] == list(range(number * size, number * size + len(got)))
    for at in (0, 99, 250, 498, 499):
        i, v = ordered[at]
        assert [(r.id, r.v) for r in pages.after([v, i], 20).collect()] == ordered[at + 1 : at + 21]
    assert [r.id for r in pages.after([None, -1], 3).collect()] == [r[0] for r in ordered[:3]]
    assert [r.id for r in pages.after([2, 10**6], 2).collect()] == [r[0] for r in ordered if r[1] == 3][:2]
    read = plan_of(pages._positions(0, 5))
    assert "PartitionFilters: [isnotnull(block" in read or "block#" in read.split("PartitionFilters")[1][:80]
    empty = PagedTable(spark, f"{tmp_path}/e", ["id"]).build(spark.createDataFrame([], "id int"), 4)
    assert empty.page(0, 10).count() == 0


def test_stratified_sample(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("cold").alias("s"))
    drawn = samples.stratified_sample(df, ["s"], ["id"], 25, "1")
    rows = drawn.collect()
    assert Counter(r.s for r in rows) == {"hot": 25, "cold": 25, None: 25}
    again = samples.stratified_sample(df.repartition(13), ["s"], ["id"], 25, "1").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sorted(map(str, rows)) != sorted(map(str, samples.stratified_sample(df, ["s"], ["id"], 25, "2").collect()))
    assert plan_of(samples.stratified_sample(df, ["s"], ["id"], 25, "3")).count("WindowGroupLimit") >= 2  # before and after the shuffle
    few = samples.stratified_sample(df.filter("id < 4"), ["s"], ["id"], 25, "1")
    assert few.count() == 4


def test_sketches_merge_to_what_one_sketch_gives(spark):
    df = spark.range(60_000).select((F.col("id") % 6).alias("day"), (F.col("id") % 20_000).alias("user"), F.when(F.col("id") % 10 > 0, F.sqrt("id")).alias("v"))
    month = sketches.merge_sketches(sketches.sketch(df, ["day"], "user", "v"), [])
    told = month.select("n", sketches.distinct_count().alias("users"), *[sketches.quantile(q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)]).first()
    assert told.n == 60_000 and abs(told.users - 20_000) <= 3 * sketches.DISTINCT_ERROR * 20_000
    for q in (0.1, 0.5, 0.9):
        share = df.filter(F.col("v") <= told[f"q{int(q * 100)}"]).count() / df.filter("v IS NOT NULL").count()
        assert abs(share - q) <= 2 * sketches.RANK_ERROR


def test_subtotals_tell_nulls_from_totals(spark):
    rows = [("x", 1, 10), ("x", None, 20), (None, 1, 40), (None, None, 80)]
    df = spark.createDataFrame(rows, "a string, b int, v int")
    got = {(r.a, r.b, r.total_of): (r.grouping_id, r.v) for r in grouping.subtotals(df, ["a", "b"], grouping.cube_sets(["a", "b"]), [F.sum("v").alias("v")]).collect()}
    assert got[(None, None, "")] == (0, 80) and got[(None, None, "b")] == (1, 120) and got[(None, None, "a")] == (2, 100) and got[(None, None, "a,b")] == (3, 150)
    assert len(got) == 4 + 2 + 2 + 1
    assert grouping.rollup_sets(["a", "b"]) == [["a", "b"], ["a"], []]
