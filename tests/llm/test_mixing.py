import collections
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing

from .conftest import SCHEMA


def water_fill(sizes, share=1.5, limit=2.0):
    """Targets by resharing the excess until none is above its limit."""
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        total = sum(rest.values())
        over = [s for s, w in rest.items() if left * w / total > limit * sizes[s]]
        if not over:
            return full | {s: left * w / total for s, w in rest.items()}
        for s in over:
            full[s] = limit * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def highest_quotients(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("weights,seats", [([53, 24, 23], 7), ([1, 1, 1, 1], 6), ([1000, 1, 1], 50), ([5], 9), ([0, 3, 9, 2], 40)])
def test_apportionment_matches_seat_by_seat(spark, weights, seats):
    rows = spark.createDataFrame([(i, float(w), seats, 10**6) for i, w in enumerate(weights)], "k long, w double, seats long, most long")
    got = {r.k: r.quota for r in mixing.apportion(rows, ["k"], [], "w", "seats", "most", [F.col("k")]).collect()}
    assert [got[i] for i in range(len(weights))] == highest_quotients(weights, seats)


def test_odd_rows(odd_docs, clashing, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    expected = water_fill(dict(sizes))
    for s in expected:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(clashing).collect()))


def test_targets_are_met_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.mix(docs).toPandas()
    per = first.groupby("source").agg({"size": "sum", "taken": "sum", "target": "first"})
    expected = water_fill(per["size"].to_dict())
    assert all(per.target[s] == pytest.approx(t) for s, t in expected.items())
    assert ((per.taken - per.target).abs() <= 0.005 * per.target + 2).all()
    assert (first.taken <= 2 * first["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert first.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_the_mix_holds_the_words_it_claims(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    claimed = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    held, whole = collections.Counter(), {r.doc_id: r.text.split() for r in docs.collect()}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    for r in rows.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        held[r.doc_id] += len(words)
        assert r.n_chars == len(r.text)
        rest = iter(whole[r.doc_id])
        assert all(w in rest for w in words)  # in the document's order
    assert held == claimed


def test_extra_columns_survive_the_mix(clashing, no_docs):
    rows = mixing.mixed_documents(clashing)
    assert rows.columns == clashing.columns and {r.target for r in rows.collect()} == {"extra"}
    assert mixing.mixed_documents(no_docs).count() == 0


def test_a_source_of_null_texts_takes_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, "a", None), (2, None, None, None, None)], SCHEMA)
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]


def _texts(first, source, n, words):
    return [(first + k, " ".join(f"{source}{k}_{i}" for i in range(words)), "en", source, None) for k in range(n)]


def test_a_tiny_source_leaves_the_others_whole_runs(spark):
    rows = _texts(0, "a", 60, 900) + _texts(100, "b", 180, 900) + _texts(400, "c", 1, 100) + _texts(500, None, 1, 10)
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes, mixed, runs = collections.Counter(), collections.Counter(), []
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    for r in mixing.mixed_documents(docs).collect():
        at = [int(w.rsplit("_", 1)[1]) for w in r.text.split()]
        mixed[r.source] += len(at)
        if r.source in ("a", "b") and len(at) < 900:
            runs.append(len(at) / (1 + sum(y != x + 1 for x, y in zip(at, at[1:], strict=False))))
    assert runs and sum(runs) / len(runs) >= 50
    for source, target in water_fill(dict(sizes)).items():
        assert abs(mixed[source] - target) <= 1


def test_large_sources_of_short_texts_meet_their_targets(spark):
    short = spark.range(200_000).selectExpr("id AS doc_id", "array_join(array_repeat('w', CAST(1 + id % 5 AS INT)), ' ') AS text", "'en' AS lang", "'a' AS source", "0L AS n_chars")
    long = spark.range(2_000).selectExpr("1000000 + id AS doc_id", "array_join(array_repeat('w', 400), ' ') AS text", "'en' AS lang", "IF(id % 2 = 0, 'b', 'c') AS source", "0L AS n_chars")
    per = mixing.mix(short.union(long)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 3 and all(abs(r.taken - r.target) <= 1 for r in per)


def test_quotas_down_a_tree_keep_every_seat(spark):
    """Two levels of fan-out 4: all seats are dealt, none over its limit, and each shard is within a seat a level of its share."""
    words = [(s, k, 100 + (k * 37) % 50) for s, n in (("a", 14), ("b", 3), (None, 1)) for k in range(n)]
    cells = spark.createDataFrame([(s, k, w, 2 * w, 64) for s, k, w in words], "source string, shard long, words long, most long, block long")
    sources = spark.createDataFrame([("a", 2000, 14), ("b", 123, 3), (None, 7, 1)], "source string, seats long, shards long")
    got = collections.defaultdict(dict)
    for r in mixing.shard_quotas(cells, sources, fan_out=4).collect():
        got[r.source][r.shard] = (r.quota, r.words)
    for source, seats in (("a", 2000), ("b", 123), (None, 7)):
        total = sum(w for _, w in got[source].values())
        assert sum(q for q, _ in got[source].values()) == seats
        assert all(q <= 2 * w and abs(q - seats * w / total) <= 3 for q, w in got[source].values())


def test_nearly_all_rows_in_one_source_without_numbers(spark):
    """90 % of the rows in one source, most without a doc_id, some repeated: targets are met, rows kept, reruns agree."""
    rows = [(None if i % 3 else i, f"word{i % 400} " * (1 + i % 9), "en", "big" if i % 10 else "small", None) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, rows_per_shard=64)
    assert got.count() == len(rows)
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("shard").alias("shards")).collect():
        assert abs(r.taken - r.target) <= 1 and r.shards > 5
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs.repartition(5), rows_per_shard=64).collect()))
    mixed = mixing.mixed_documents(docs, rows_per_shard=64).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words")).collect()
    assert {r.source: r.words for r in mixed} == {r.source: r.taken for r in got.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
