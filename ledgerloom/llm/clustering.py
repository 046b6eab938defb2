"""Exact k-means over integer vectors, filtered by ball trees.

Vectors are gathered in blocks where they lie, each block a metric tree: a ball has a centre, a radius, its number of vectors and the integer
sum of their components; leaves hold the vectors. Trees are built once and written; a round is a pass over them. From the root down, a
ball keeps the centroids that may be nearest to one of its vectors: by the triangle inequality those no further from its centre than the
nearest one and twice the radius. A ball with one such centroid goes to it whole, its count and sum with it; leaves with several compare
their vectors exactly. All comparisons that decide are between integers, or between roots with a margin above their rounding, so the
result is that of comparing every vector with every centroid; ties go to the smaller number. A task gives a row for each centroid, and
only k rows of sums come to the driver, however many vectors there are, and however many of them are alike.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; components are
floor(scale * x), held within 2^27 in magnitude so that every squared distance is a long. Rows that repeat a vec_id or a vector each count;
null ids are kept, last in the order of first centroids. Fewer vectors than k give as many centroids; none give no rows. Sums of distances
that no long can hold count as the largest long. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written
from ledgerloom.llm.workers import map_batches

_BLOCK, _LEAF = 16_384, 32
_WIDEST, _EXACT = 1 << 27, 1 << 53
_MARGIN = 1e-12
_LONGEST = (1 << 63) - 1

_TREE = "vec_ids array<long>, points binary, first binary, last binary, left binary, centres binary, radii binary, sums binary"


@dataclass
class Clustering:
    """assigned: (vec_id, cluster, distance) of each vector; centroids: (cluster, centroid, size, inertia) of each centroid."""

    assigned: DataFrame
    centroids: DataFrame


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the whole vectors of dims finite components, as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    edge = F.lit(float(_WIDEST))
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -edge), edge)).cast("int"))
    return vectors.filter((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest hash of seed:vec_id, in the hashes' order; equal ids in their vectors' order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def square_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer points; by a matrix product where doubles hold every term exactly."""
    widest = int(max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * widest * widest < _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Tree:
    """Balls in order of depth. Ball i holds points first[i]:last[i]; its halves are left[i] and left[i] + 1, or left[i] is 0."""

    def __init__(self, ids: list, points: np.ndarray, first, last, left, centres, radii, sums):
        self.ids, self.points, self.first, self.last, self.left = ids, points, first, last, left
        self.centres, self.radii, self.sums = centres, radii, sums

    @classmethod
    def build(cls, ids: list, points: np.ndarray) -> Tree:
        order = np.arange(len(points))
        first, last, left, centres, radii, sums = [0], [len(points)], [0], [], [], []
        at = 0
        while at < len(first):
            lo, hi = first[at], last[at]
            members = points[order[lo:hi]]
            total = members.sum(axis=0)
            centre = total // (hi - lo)
            squares = ((members - centre) ** 2).sum(axis=1)
            centres.append(centre)
            sums.append(total)
            radii.append(float(squares.max()) ** 0.5 * (1 + _MARGIN))
            if hi - lo > _LEAF and squares.max():
                # Two far ends; half of the members lie nearer to the one.
                one = members[int(squares.argmax())]
                from_one = ((members - one) ** 2).sum(axis=1)
                other = members[int(from_one.argmax())]
                nearer = from_one.astype(np.float64) - ((members - other) ** 2).sum(axis=1)
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(nearer, half)]
                left[at] = len(first)
                first += [lo, lo + half]
                last += [lo + half, hi]
                left += [0, 0]
            at += 1
        ints = [np.array(x, np.int32) for x in (first, last, left)]
        return cls([ids[i] for i in order], points[order], *ints, np.array(centres), np.array(radii), np.array(sums))

    def row(self) -> tuple:
        kinds = ((self.points, "<i4"), (self.first, "<i4"), (self.last, "<i4"), (self.left, "<i4"), (self.centres, "<i4"), (self.radii, "<f8"), (self.sums, "<i8"))
        return (self.ids, *[x.astype(kind).tobytes() for x, kind in kinds])

    @classmethod
    def of_row(cls, row: dict, dims: int) -> Tree:
        def read(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row[name], kind)

        points, centres, sums = (read(n, k).reshape(-1, dims).astype(np.int64) for n, k in (("points", "<i4"), ("centres", "<i4"), ("sums", "<i8")))
        ints = [read(n, "<i4") for n in ("first", "last", "left")]
        return cls(row["vec_ids"], points, *ints, centres, read("radii", "<f8"), sums)

    def settle(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(ball, its possible centroids in ascending order): one for a ball that goes whole, several for a leaf to compare; each vector once."""
        distances = np.sqrt(square_distances(self.centres, centroids).astype(np.float64))
        level, candidates = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(level):
            d, r = distances[level], self.radii[level][:, None]
            reach = np.where(candidates, d + r, np.inf).min(axis=1, keepdims=True)
            candidates = candidates & (d - r <= reach + _MARGIN * (reach + d + r + 1))
            closed = (candidates.sum(axis=1) == 1) | (self.left[level] == 0)
            for i in np.flatnonzero(closed):
                yield int(level[i]), np.flatnonzero(candidates[i])
            halves, candidates = self.left[level[~closed]].astype(np.int64), np.repeat(candidates[~closed], 2, axis=0)
            level = np.stack([halves, halves + 1], axis=1).ravel()

    def nearest(self, ball: int, candidates: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each of a ball's vectors and the squared distance to it."""
        squares = square_distances(self.points[self.first[ball] : self.last[ball]], centroids[candidates])
        which = squares.argmin(axis=1)
        return candidates[which], squares[np.arange(len(which)), which]


def ball_trees(vectors: DataFrame, dims: int) -> DataFrame:
    """A row for each block's tree, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0

        def tree() -> pa.RecordBatch:
            row = Tree.build([i for part in ids for i in part], np.concatenate(points)).row()
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], [c.split()[0] for c in _TREE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                if held + part.num_rows > _BLOCK and held:
                    yield tree()
                    ids, points, held = [], [], 0
                ids.append(part.column(0).to_pylist())
                points.append(part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims))
                held += part.num_rows
        if held:
            yield tree()

    return written(map_batches(vectors, run, _TREE), "ball-trees")


def cluster_sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """The number of vectors and the component sums of each centroid that has any."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.of_row(row, dims)
                for ball, candidates in tree.settle(centroids):
                    lo, hi = tree.first[ball], tree.last[ball]
                    if len(candidates) == 1:
                        sizes[candidates[0]] += hi - lo
                        sums[candidates[0]] += tree.sums[ball]
                    else:
                        which, _ = tree.nearest(ball, candidates, centroids)
                        sizes += np.bincount(which, minlength=k)
                        np.add.at(sums, which, tree.points[lo:hi])
        found = np.flatnonzero(sizes)
        columns = [pa.array(found.astype(np.int32)), pa.array(sizes[found]), pa.array(sums[found].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "size", "sums"])

    partial = map_batches(trees, run, "cluster int, size long, sums array<long>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = partial.groupBy("cluster").agg(F.sum("size").alias("size"), *each).collect()
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in rows}


def assign(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector in the trees."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.of_row(row, dims)
                cluster, distance = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
                for ball, candidates in tree.settle(centroids):
                    at = slice(tree.first[ball], tree.last[ball])
                    cluster[at], distance[at] = tree.nearest(ball, candidates, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return map_batches(trees, run, "vec_id long, cluster int, distance long")


def long_sum(column: str) -> Column:
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> Clustering:
    """k-means of the vectors (vec_id, embedding) in a fixed number of rounds; empty centroids stay where they are."""
    kept = integer_vectors(vectors, dims, scale)
    centroids, trees = first_centroids(kept, k, seed), ball_trees(kept, dims)
    spark = vectors.sparkSession
    if not len(centroids):
        none = spark.createDataFrame([], "cluster int, centroid array<long>, size long, inertia long")
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), none)
    for _ in range(rounds):
        for c, (size, sums) in cluster_sums(trees, centroids).items():
            centroids[c] = [s // size for s in sums]
    assigned = written(assign(trees, centroids), "assigned")
    found = assigned.groupBy("cluster").agg(F.count("*").alias("size"), long_sum("distance").alias("inertia"))
    told = spark.createDataFrame([(c, v) for c, v in enumerate(centroids.tolist())], "cluster int, centroid array<long>")
    sized = told.join(found, "cluster", "left").select("cluster", "centroid", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("inertia", F.lit(0)).alias("inertia"))
    return Clustering(assigned, written(sized.coalesce(1), "centroids"))
