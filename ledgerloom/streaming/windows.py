"""Event-time windows over a stream of files, late rows apart.

Two streams in a row. The first takes arriving files in batches, in the order of arrival, and parts their rows: a row is late if it is older
than the newest event of all earlier batches less the lateness. Late rows and rows in time go to folders of their own, one for each
batch, written anew if a batch runs again; how far time has come is one row a batch. The second stream reads the rows in time and counts
them in windows under a watermark of the same lateness. It may take several batches at once but never knows a later time than the first
did, so it drops nothing: every row that arrived is in a window, still to be counted, or among the late rows. Rows without a time are never
late and in no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

TUMBLING, SLIDING, SESSION = "tumbling", "sliding", "session"


def window_of(kind: str, time: str, length: str, slide: str | None = None) -> Column:
    """The window column of a kind; a session ends when nothing comes for its length."""
    if kind == SESSION:
        return F.session_window(time, length)
    if kind == SLIDING:
        return F.window(time, length, slide)
    return F.window(time, length)


class EventTime:
    """The streams of one folder: `arrived`, `late`, `in_time`, `clock`, and a table for each window."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, time: str, lateness: str):
        self.spark, self.folder, self.schema, self.time, self.lateness = spark, folder.rstrip("/"), schema, time, lateness

    def arrive(self, rows: DataFrame) -> None:
        """Rows as files that arrive now."""
        rows.select(*self.schema.names).write.mode("append").parquet(f"{self.folder}/arrived")

    def _clock(self, batch: int) -> DataFrame:
        """One row: the newest event of the batches before, null before the first."""
        if batch == 0:
            return self.spark.range(1).select(F.lit(None).cast("timestamp").alias("seen"))
        return self.spark.read.schema("seen timestamp").parquet(f"{self.folder}/clock/batch={batch - 1}").agg(F.max("seen").alias("seen"))

    def _part(self, rows: DataFrame, batch: int) -> None:
        seen = self._clock(batch).scalar()
        late = F.coalesce(F.col(self.time) < seen - F.expr(f"INTERVAL {self.lateness}"), F.lit(False))
        told = rows.withColumn("late", late)
        told.write.mode("overwrite").partitionBy("late").parquet(f"{self.folder}/judged/batch={batch}")
        judged = self.spark.read.schema(told.schema).parquet(f"{self.folder}/judged/batch={batch}")
        newest = judged.agg(F.max(self.time).alias("newest")).select(F.greatest(F.col("newest"), seen).alias("seen"))
        newest.write.mode("overwrite").parquet(f"{self.folder}/clock/batch={batch}")

    def part_late_rows(self) -> StreamingQuery:
        """Parts everything that has arrived since the last call, as one batch."""
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/arrived").writeStream.foreachBatch(self._part)
        return stream.option("checkpointLocation", f"{self.folder}/checkpoint-arrived").trigger(availableNow=True).start()

    def _judged(self, late: bool) -> DataFrame:
        rows = self.spark.read.schema(StructType(self.schema.fields).add("late", "boolean").add("batch", "integer")).parquet(f"{self.folder}/judged")
        return rows.filter(F.col("late") == late).drop("late")

    def late_rows(self) -> DataFrame:
        """The late rows, with the batch that brought them."""
        return self._judged(True)

    def rows_in_time(self) -> DataFrame:
        return self._judged(False)

    def count_windows(self, name: str, window: Column, keys: list[str], sums: list[Column]) -> StreamingQuery:
        """Closed windows (keys, window_start, window_end, sums) into the table of that name; each comes once, when the watermark passes it."""
        schema = StructType(self.schema.fields).add("late", "boolean").add("batch", "integer")
        rows = self.spark.readStream.schema(schema).parquet(f"{self.folder}/judged").filter("NOT late").drop("late", "batch")
        grouped = rows.withWatermark(self.time, self.lateness).groupBy(*keys, window.alias("w")).agg(*sums)
        told = grouped.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c not in (*keys, "w")])
        stream = told.writeStream.format("parquet").option("path", f"{self.folder}/{name}").option("checkpointLocation", f"{self.folder}/checkpoint-{name}")
        return stream.outputMode("append").trigger(availableNow=True).start()

    def windows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")
