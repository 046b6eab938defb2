"""Classes of similar things from hash buckets, without listing all pairs of a bucket.

Each bucket's most popular member (the one whose buckets are fullest: the hub of a group of copies) is compared with all other
members of its bucket. Links become classes by alternating large-star and small-star steps. A bucket is settled when all its members
but the hub share a class: the hub has been compared with each, so nothing there can join classes any more. The members of the other buckets are handed to `rivals`, which finds the links
left among them by whatever exact filter the measure allows. So no link between classes is lost, and pairs are linear in the members
for groups that hold together, however large.

Tables are written to the shared folder, small ones in few files. Joins on a hot bucket are plain equi-joins between written tables,
which AQE splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import mark, sweep, written

_ROWS_PER_FILE, _SLOTS = 500_000, 1 << 22


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b), the label being the smallest node it is connected with."""
    start = mark()
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(current)
    while seen[0]:
        files = 1 + 2 * seen[0] // _ROWS_PER_FILE
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(files), "lowest")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(files), "large-star")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "lowest")
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        current = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files), "small-star")
        sweep(current.sparkSession, start)
        now = _signature(current)
        if now == seen:
            break
        seen = now
    # Now every edge leads from a node to the smallest of its component.
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def asked_only(rows: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """The rows whose column's value is among the asked, and a few more: the others are told apart by a broadcast table of _SLOTS hashes at
    most, whatever their number, so that no join moves them. It holds back less as the asked values near _SLOTS, and nothing far above."""
    slot = F.pmod(F.xxhash64(column), F.lit(_SLOTS))
    return rows.join(F.broadcast(asked.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")


def shared_buckets(members: DataFrame, sparse: bool = False) -> DataFrame:
    """The members (key, node), each once, of keys with two nodes or more, with the node's popularity; sparse: most keys have one node."""
    counts = written(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    full = written((asked_only(members, counts, "key") if sparse else members).join(counts, "key"), "bucket-full")
    popular = written(full.groupBy("node").agg(F.sum("size").alias("popularity")), "popularity")
    return written(full.select("key", "node").join(popular, "node"), "buckets")


def number_nodes(rows: DataFrame, content: list[str], where: list[str]) -> DataFrame:
    """(content, id, where, node) of each content once: the smallest id with it, the place of a row that has it, and its number.

    The number is that id; of several contents under one id one keeps it, the others get negative numbers made from what they hold.
    """
    first = rows.groupBy(*content).agg(F.min(F.struct("id", *where)).alias("first"))
    firsts = written(first.select(*content, *[F.col(f"first.{c}").alias(c) for c in ("id", *where)]), "firsts")
    taken = firsts.groupBy("id").agg(F.count("*").alias("many"), F.min(F.struct(*content)).alias("own")).filter("many > 1").select("id", "own")
    spare = F.col("own").isNotNull() & (F.struct(*content) != F.col("own"))
    node = F.when(spare, F.lit(-1) - F.shiftrightunsigned(F.xxhash64(*content), 1)).otherwise(F.col("id"))
    return written(firsts.join(taken, "id", "left").select(*content, "id", *where, node.alias("node")), "nodes")


def classes(buckets: DataFrame, compare: Callable[[DataFrame], DataFrame], rivals: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of the linked nodes, the label being the smallest node of the class.

    buckets has (key, node, popularity); compare takes pairs (a, b), a < b, and returns those that are similar; rivals takes (node,
    label) and returns every link (a, b) between nodes of different labels.
    """
    start, rank = mark(), F.struct("popularity", (-F.col("node")).alias("low"))
    leaders = written(buckets.groupBy("key").agg(F.max_by("node", rank).alias("leader")), "leaders")
    led = buckets.join(leaders, "key").filter("node <> leader")
    pairs = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = written(compare(written(pairs, "pairs")), "links")
    labels = written(components(links), "labels")
    labelled = led.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = written(labelled, "open-members")
    unsettled = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    rest = written(labelled.join(written(unsettled, "unsettled"), "key").select("node", "label").distinct(), "open-nodes")
    if not rest.isEmpty():
        labels = written(components(written(links.union(rivals(rest)), "all-links")), "labels")
        sweep(labels.sparkSession, start)
    return labels
