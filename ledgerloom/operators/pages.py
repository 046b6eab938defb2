"""Pages of a table in an order, by a sparse directory of the order's ranges: a page reads the one or two blocks that hold it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class PagedTable:
    """A table in a folder: `rows` in blocks by range of the order, `directory` with a row for each block, `schema`.

    The order must be total; nulls come first. The directory is as long as the number of blocks, whatever the table's size.
    """

    def __init__(self, spark: SparkSession, folder: str, order: Sequence[str]):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), list(order)

    def build(self, rows: DataFrame, blocks: int) -> PagedTable:
        ranged = rows.repartitionByRange(blocks, *self.order).sortWithinPartitions(*self.order)
        ranged.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{self.folder}/rows")
        key = F.struct(*self.order)
        self.spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.text(f"{self.folder}/schema")
        sizes = self._rows().groupBy("block").agg(F.count("*").alias("n"), F.min(key).alias("first"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes.withColumn("start", before).write.parquet(f"{self.folder}/directory")
        return self

    def _rows(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema").first().value))
        return self.spark.read.schema(schema.add("block", "integer")).parquet(f"{self.folder}/rows")

    def directory(self) -> DataFrame:
        """(block, n, first, start): each block's number of rows, first key and first position."""
        return self.spark.read.parquet(f"{self.folder}/directory")

    def _positions(self, low: int, high: int) -> DataFrame:
        """Rows at positions low to high, the last one not included, with their position; only their blocks are read."""
        met = self.directory().filter((F.col("start") < high) & (F.col("start") + F.col("n") > low)).select("block", "start").collect()
        starts = F.create_map(*[F.lit(x) for r in met for x in (r.block, r.start)]) if met else F.create_map(F.lit(-1), F.lit(0))
        place = F.row_number().over(Window.partitionBy("block").orderBy(*self.order)) - 1
        found = self._rows().filter(F.col("block").isin([r.block for r in met]))
        told = found.withColumn("position", F.element_at(starts, F.col("block")).cast("long") + place)
        return told.filter((F.col("position") >= low) & (F.col("position") < high)).drop("block")

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` from 0, rows in order."""
        return self._positions(number * size, (number + 1) * size).orderBy("position")

    def after(self, key: Sequence, size: int) -> DataFrame:
        """The next size rows after a key (the values of the order's columns): the cursor of a page is the key of its last row."""
        types = {f.name: f.dataType for f in self._rows().schema}
        cursor = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(self.order, key, strict=True)])
        block = self.directory().filter(F.col("first") <= cursor).agg(F.max("block").alias("block"), F.max("start").alias("start")).first()
        if block.block is None:
            return self._positions(0, size).orderBy("position")
        upto = self._rows().filter((F.col("block") == block.block) & (F.struct(*self.order) <= cursor)).count()
        return self._positions(block.start + upto, block.start + upto + size).orderBy("position")
