"""A training corpus from raw documents: five stages, each over all that the one before kept.

quality: documents that the classifier rejects go. near_dedup: one document of each class of copies stays. decontamination: documents
contaminated by the benchmark go, all others stay as they are. mixing: the mix's rows, repeats and cuts included. sharding: every row
with its shard and slot. All but the last return the columns of documents; between stages rows are written as Parquet.

Defined results, as the operators define them: null and empty texts are scored, deduplicated (all together one class) and uncontaminated,
and the mix takes nothing of them; very long texts pass whole; rows that repeat a doc_id are judged each by its own text; ties go to the
smaller number; an empty table gives an empty result with the columns of documents, shard and slot; extra columns, whatever their names,
stay (those named shard or slot give way to the last stage's).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontamination, mixing, near_dedup, quality, sharding
from ledgerloom.llm.scratch import mark, sweep, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(quality.document_statistics(docs), labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No stage but the last two could be told in SQL; the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all stages' survivors. Once a stage's rows are written, what it and the stage before it left in the shared folder goes."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
