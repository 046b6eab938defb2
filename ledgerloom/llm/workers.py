"""Bounded memory of Python workers: Arrow batches limited by bytes, and pools given back at the end of each partition."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH = "8m"

Batches = Iterator[pa.RecordBatch]


def _bound_batches(spark: SparkSession) -> None:
    """Limits an Arrow batch's bytes, as a number of rows alone is no bound; a limit in the application's settings stays."""
    if not spark.sparkContext.getConf().contains(_LIMIT):
        spark.conf.set(_LIMIT, _BATCH)


def give_back() -> None:
    """Memory that this worker no longer uses goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(rows: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) with bounded batches; what a worker keeps after a partition is what run keeps."""
    _bound_batches(rows.sparkSession)

    def bounded(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(bounded, schema)
