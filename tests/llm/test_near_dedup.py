import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import near_dedup, registry

from .conftest import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def bag(text):
    words = WORD.findall((text or "").translate(UPPER))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    """doc_id -> smallest doc_id, by all pairs."""
    bags = [bag(t) for _, t in rows]
    sizes = [sum(b.values()) for b in bags]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            holders[s].append(i)
    for i, b in enumerate(bags):
        shared = Counter()
        for s, n in b.items():
            for j in holders[s]:
                if j < i:
                    shared[j] += min(n, bags[j][s])
        for j, common in shared.items():
            if common >= 0.8 * (sizes[i] + sizes[j] - common):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return {doc_id: smallest[root(i)] for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    expected = classes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in registry.op6_near_dedup(spark, f"/root/testdata/{sf}").collect()}
    assert got == expected


def test_a_hot_group_of_unlike_neighbours(spark):
    """A third are copies, a third near copies, the rest share most of their words with both, below and above the similarity."""
    rng = random.Random(5)
    core = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for i in range(600):
        words = list(core)
        for _ in range(0 if i % 3 == 0 else rng.randint(1, 3) if i % 3 == 1 else rng.randint(1, 30)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingles = np.arange(300, dtype=np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    row = np.repeat([0, 1], 300)
    signature = near_dedup.signatures(row, np.concatenate([shingles, shingles]), np.concatenate([a, b]), 2, 4096)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - truth) < 0.03


def test_odd_rows(odd_docs, clashing, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    by_id = {r.doc_id: r.class_id for r in got}
    assert len(got) == odd_docs.count() and by_id[1] == by_id[8] == 1 and by_id[3] == by_id[4] == by_id[10] == 3
    assert sorted(map(str, got)) == sorted(map(str, near_dedup.near_duplicates(clashing).collect()))
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_keep_one(odd_docs, clashing, no_docs):
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 5, 6, 7, 9)] + [(True, None)]
    assert near_dedup.keep_one(no_docs).count() == 0


def test_rows_that_share_a_number_keep_their_own_texts(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "quite another text under the same number", "de", "a", 2), (1, "One two three, four five six!", "en", "b", 3), (2, "one two three four five six", "en", "a", 4), (2, "one two three four five six", "en", "a", 4), (None, "no number", "en", "a", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(docs).collect())
    assert len(kept) == 3 and kept[0] == (0, "no number") and (1, rows[1][1]) in kept
    assert kept == sorted((r.doc_id or 0, r.text) for r in near_dedup.keep_one(docs.repartition(5)).collect())
    classes = {(r.id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert len({c for _, c in classes}) == 3


def test_blocks_give_every_link_of_a_hot_key(spark):
    """Blocks far smaller than the key's texts: the links are those of all pairs of asking and asked texts."""
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**62, 30)
    sets = [np.unique(np.concatenate([core[rng.random(30) < 0.95], rng.integers(0, 2**62, rng.integers(0, 4))])) for _ in range(60)]
    label = [0 if i < 40 else i for i in range(60)]
    held = spark.createDataFrame([(i, label[i], [int(e) for e in s]) for i, s in enumerate(sets)], "node long, label long, elements array<long>")
    warm = spark.createDataFrame([(7, i, label[i], 0) for i in range(60)], "key long, node long, label long, main long")
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    expected = {(min(i, j), max(i, j)) for i in range(40, 60) for j in range(60) if label[i] != label[j] and similar(sets[i], sets[j])}
    for size in (50, 500_000):
        got = [(r.a, r.b) for r in near_dedup._block_links(warm, held, 0.8, block_elements=size).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert len(expected) > 20
    assert near_dedup._block_links(warm.limit(0), held, 0.8).count() == 0


def test_only_texts_of_candidates_are_moved(spark, monkeypatch):
    """Joins that may not broadcast: of 400 texts two are candidates, and the joins of their texts see these only."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), None, None, None) for i in range(400)]
    rows[7] = (7, rows[3][1] + " more", None, None, None)
    seen = []
    real = near_dedup._elements
    monkeypatch.setattr(near_dedup, "_elements", lambda texts, shingle: (seen.append(texts), real(texts, shingle))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: 3 if i == 7 else i for i in range(400)}
    assert len(re.findall(r"BroadcastHashJoin .*LeftSemi", plan)) == 2  # below each of the two joins on ids
    texts = near_dedup._asked_only(spark.range(400).selectExpr("id", "id AS th"), spark.createDataFrame([(3,), (7,)], "id long"))
    assert {3, 7} <= {r.id for r in texts.collect()} and texts.count() < 10
