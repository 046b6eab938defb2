import hashlib

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import clustering, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=40, rounds=5, dims=64, scale=256, widest=1 << 27):
    """(vec_id, cluster, distance) and the centroids, in Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(min(max(float(x) * scale, -widest), widest))) for x in v]))
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, of in members.items():
            centroids[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def check(df, **options):
    got = clustering.cluster(df, **options)
    found = sorted([tuple(r) for r in got.assigned.collect()], key=str)
    expected, centroids = brute([(r.vec_id, r.embedding) for r in df.collect()], **options)
    assert found == sorted(expected, key=str)
    rows = {r.cluster: r for r in got.centroids.collect()}
    assert [rows[c].centroid for c in range(len(centroids))] == centroids
    for c, r in rows.items():
        own = [d for _, j, d in expected if j == c]
        assert (r.size, r.inertia) == (len(own), min(sum(own), (1 << 63) - 1))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.op11_clustering(spark, sf).collect()
    expected, centroids = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    of = {}
    for _, c, d in expected:
        of[c] = of.get(c, 0) + d
    told = [(i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in expected]
    assert sorted(tuple(r) for r in rows) == sorted(told)


def test_sql_equivalent(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    found = con.execute(registry.oracle_sql()["op11_clustering"])
    names = [c[0] for c in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r[n] for n in names) for r in registry.op11_clustering(spark, sf).collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    whole = [(i, rng.normal(size=4).round(3).tolist(), None) for i in range(100)]
    rows = [
        *whole,
        (7, whole[7][1], 1),
        (None, [1.0, 2.0, 3.0, 4.0], 1),
        (None, [0.0, 2.0, 3.0, 4.0], 1),
        (200, None, 1),
        (201, [], 1),
        (202, [1.0, 2.0, 3.0], 1),
        (203, [1.0, 2.0, 3.0, None], 1),
        (204, [1.0, 2.0, 3.0, float("nan")], 1),
        (205, [1.0, float("inf"), 3.0, 4.0], 1),
        (206, [3e38, -3e38, 1e6, 0.0], 1),
        (207, [-3e38, 3e38, 1e6, -0.0], 1),
        *[(300 + i, [0.5, 0.5, 0.5, 0.5], None) for i in range(300)],
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_vectors_ties_and_repeats(spark, odd):
    check(odd, k=5, dims=4)
    check(odd, k=40, dims=4, rounds=2)
    check(odd.withColumnsRenamed({"label": "cluster"}).selectExpr("*", "1 AS distance", "2 AS size", "3 AS v", "4 AS h"), k=3, dims=4, rounds=1)


def test_fewer_vectors_than_centroids_and_none(spark, odd):
    check(odd.filter("vec_id < 3"), k=5, dims=4)
    none = clustering.cluster(odd.filter("false"), dims=4)
    assert none.assigned.count() == 0 and none.centroids.count() == 0


def test_balls_settle_every_vector_once():
    rng = np.random.default_rng(8)
    for spread, wide in ((3, 4), (400, 1), (1 << 26, 1)):
        middles = rng.integers(-spread * 20, spread * 20 + 1, (12, 6)).clip(-(1 << 27), 1 << 27)
        points = (middles[rng.integers(0, 12, 3000)] + rng.integers(-wide, wide + 1, (3000, 6))).clip(-(1 << 27), 1 << 27)
        tree = clustering.Tree.of_row(dict(zip([c.split()[0] for c in clustering._TREE.split(", ")], clustering.Tree.build(list(range(3000)), points).row(), strict=True)), 6)
        centroids = np.concatenate([middles, middles[:3]])
        whole, seen, exact = 0, np.zeros(3000, int), ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
        for ball, candidates in tree.settle(centroids):
            at = slice(tree.first[ball], tree.last[ball])
            which, squares = tree.nearest(ball, candidates, centroids)
            ids = np.array(tree.ids[at])
            seen[ids] += 1
            whole += len(candidates) == 1 and len(ids) > 1
            assert (which == exact[ids].argmin(axis=1)).all() and (squares == exact[ids].min(axis=1)).all()
            assert (tree.sums[ball] == points[ids].sum(axis=0)).all()
        assert (seen == 1).all() and whole > 0
