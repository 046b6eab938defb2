"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import new_folder


class _Made(threading.local):
    """The folders of a thread's intermediate tables, in the order in which they were made: queries of other threads keep theirs."""

    def __init__(self):
        self.folders: list[str] = []

    def __getitem__(self, which):
        return self.folders[which]


_MADE = _Made()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _MADE.folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where the tables made from now on begin, for sweep."""
    return len(_MADE.folders)


def sweep(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Removes the tables made since a mark, but for the last ones: for callers whose result is written and needs nothing else."""
    made = _MADE.folders
    last = len(made) - keep
    gone, made[since:last] = made[since:last], []
    for folder in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
