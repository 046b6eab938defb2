"""Sharding: longest-processing-time scheduling of text groups onto shards.

Equal texts must share a shard. Group sizes are summed map-side, and a heap gives each group, largest first, to the least-loaded shard.
Groups of one size are alike to the heap, so the driver holds the number of groups of each size: it deals them size by size, and a size's
groups, ranked by their hash, go to the shards by ranges of ranks. Loads are those of dealing out all groups one by one. Different sizes
whose sum is the input's bytes are at most sqrt(2 * bytes) many, 16 bytes each: 8 MB for 100 GB of the least even input, 230 MB for 100 TB;
texts of less than a million bytes have a million sizes at most, however many there are. Many groups of one size are dealt by
arithmetic instead of one by one. Ranks are counted in hash cells of about rows_per_cell groups, with the cells' own counts before them.

Slots number the rows of a shard without gaps: rows go to hash cells of about rows_per_cell documents, cells get offsets from
running sums of their counts in two levels, and rows are numbered inside their cell.

Defined results: null text has no bytes and belongs with the empty text; rows that repeat a doc_id each get a slot, in the order of their
texts' hashes, as do rows without one; equal rows take slots one after the other; very long texts are only measured and moved; an empty
table gives no rows; extra columns, whatever their names, are ignored, or kept by shard_documents unless named shard or slot. One text
group above 1/shards of all bytes makes its shard that much larger.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import rows
from ledgerloom.llm.scratch import written

_ONE_BY_ONE = 300


def _levelled(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard gets when each goes to the least-loaded shard: the n smallest of load + k * size."""

    def upto(level: int) -> list[int]:
        return [max(0, (level - load) // size + 1) for load in loads]

    low, high = min(loads), max(loads) + n * size
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(upto(middle)) >= n else (middle + 1, high)
    given = upto(low - 1)
    for shard, more in enumerate(upto(low)):
        if more > given[shard] and sum(given) < n:
            given[shard] += 1
    return given


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, the number of groups for each shard) of (size, number of groups), largest first; ties go to the smaller shard."""
    loads = [(0, shard) for shard in range(shards)]
    for size, n in sorted(sizes, reverse=True):
        given = [0] * shards
        if n <= _ONE_BY_ONE:
            for _ in range(n):
                load, shard = loads[0]
                given[shard] += 1
                heapq.heapreplace(loads, (load + size, shard))
        elif not size:
            given[loads[0][1]] = n
        else:
            flat = dict((shard, load) for load, shard in loads)
            given = _levelled([flat[shard] for shard in range(shards)], size, n)
            loads = [(flat[shard] + k * size, shard) for shard, k in enumerate(given)]
            heapq.heapify(loads)
        yield size, given


def measure(docs: DataFrame, row_bytes: int = 8) -> DataFrame:
    """(key, doc_id, group, size, text_crc32, n) of the documents; group tells texts apart, null and empty ones being one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measures = {"group": F.xxhash64(text), "size": (F.octet_length(text) + F.lit(row_bytes)).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    return rows.narrow(docs, measures, "shard-rows")


def place_groups(groups: DataFrame, shards: int, rows_per_cell: int = 20_000) -> DataFrame:
    """(group, shard) of groups (group, total)."""
    counted = groups.groupBy("total").agg(F.count("*").alias("n")).toArrow()
    sizes, counts = counted["total"].to_pylist(), counted["n"].to_pylist()
    of, ends, to = [], [], []
    for size, given in longest_first(zip(sizes, counts, strict=True), shards):
        chosen = [shard for shard, k in enumerate(given) if k]
        of.append(size)
        to.append(chosen)
        ends.append(list(accumulate(given[shard] for shard in chosen)))
    columns = {"total": pa.array(of, pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64())), "to": pa.array(to, pa.list_(pa.int32()))}
    plan = groups.sparkSession.createDataFrame(pa.table(columns))

    cells = 1 + max(counts, default=0) // rows_per_cell
    parted = groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
    before = Window.partitionBy("total").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("total", "cell").agg(F.count("*").alias("n")).select("total", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("total", "cell").orderBy("group")) - 1
    ranked = parted.withColumn("inside", inside).join(starts, ["total", "cell"]).withColumn("rank", F.col("start") + F.col("inside"))
    place = F.size(F.filter("ends", lambda end: end <= F.col("rank"))) + 1
    return ranked.join(plan, "total").select("group", F.element_at("to", place).alias("shard"))


def assign(measured: DataFrame, shards: int) -> DataFrame:
    """measured with its shard."""
    groups = written(measured.groupBy("group").agg(F.sum(F.col("size") * F.col("n")).alias("total")), "text-groups")
    return measured.join(written(place_groups(groups, shards), "group-shards"), "group")


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64(*rows.KEY), F.lit(cells))


def cell_offsets(assigned: DataFrame, rows_per_cell: int = 512, cells_per_block: int = 1024) -> tuple[int, DataFrame]:
    """The number of cells of a shard, and the first slot (shard, cell, offset) of each: a running sum over blocks, then one inside each."""
    largest = assigned.groupBy("shard").agg(F.sum("n").alias("rows")).agg(F.max("rows")).first()[0] or 0
    cells = max(1, -(-largest // rows_per_cell))
    counts = assigned.groupBy("shard", _cell(cells).alias("cell")).agg(F.sum("n").alias("rows"))
    counts = written(counts.withColumn("block", F.floor(F.col("cell") / cells_per_block)), "cell-counts")

    def before(*group: str) -> Window:
        return Window.partitionBy(*group[:-1]).orderBy(group[-1]).rowsBetween(Window.unboundedPreceding, -1)

    blocks = counts.groupBy("shard", "block").agg(F.sum("rows").alias("total"))
    starts = blocks.select("shard", "block", F.coalesce(F.sum("total").over(before("shard", "block")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("rows").over(before("shard", "block", "cell")), F.lit(0))
    offsets = counts.withColumn("inside", inside).join(starts, ["shard", "block"])
    return cells, written(offsets.select("shard", "cell", (F.col("start") + F.col("inside")).alias("offset")), "shard-offsets")


def number_slots(assigned: DataFrame) -> DataFrame:
    """assigned with its first slot: rows take 0, 1, 2, ... inside each shard, those of one key consecutive ones."""
    cells, offsets = cell_offsets(assigned)
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", *rows.KEY).rowsBetween(Window.unboundedPreceding, 0)
    numbered = assigned.withColumn("cell", _cell(cells)).withColumn("inside", F.sum("n").over(order) - F.col("n")).join(offsets, ["shard", "cell"])
    return numbered.withColumn("first_slot", F.col("offset") + F.col("inside")).drop("cell", "inside", "offset")


_SLOT = "CAST(first_slot + copy AS long) AS slot"


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot)."""
    return rows.copies(number_slots(assign(measure(docs), shards))).selectExpr("doc_id", "size", "text_crc32", "shard", _SLOT)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The documents, all columns, with their shard and slot; text is moved once."""
    plan = number_slots(assign(measure(docs), shards)).select(*rows.KEY, "n", "shard", "first_slot")
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return rows.whole(docs, plan).select(*others, "shard", F.expr(_SLOT))
