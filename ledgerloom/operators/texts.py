"""Ordered text from child rows, and the checklist of required documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The required documents as (item_key, title, doc_type), and the note of a missing one.
REQUIRED = (
    ("doc_charter", "Устав компании", "charter"),
    ("doc_egrul", "Выписка ЕГРЮЛ", "extract_egrul"),
    ("doc_poa", "Доверенность", "power_of_attorney"),
    ("doc_license", "Лицензия (при необходимости)", "license"),
)
MISSING_NOTE = "Нет активного документа этого типа"
NO_ANALYSIS = "(разбор ещё не выполнен — черновик по заголовку и описанию)"


def joined_text(df: DataFrame, key: str, order: list[str], piece: Column, separator: str, name: str, limit: int | None = None) -> DataFrame:
    """Per key, the pieces in order, joined, and cut to limit characters. Null pieces are left out.

    With a limit, pieces that start past it go before anything is collected, so a key holds no more than its result.
    """
    pieces = df.select(key, *order, piece.alias("__piece"))
    if limit:
        line = Window.partitionBy(key).orderBy(*order, "__piece").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.length("__piece") + len(separator)).over(line), F.lit(0))
        pieces = pieces.withColumn("__start", start).filter(F.col("__piece").isNull() | (F.col("__start") < limit))
    held = F.when(F.col("__piece").isNotNull(), F.struct(*order, "__piece"))
    rows = pieces.groupBy(key).agg(F.sort_array(F.collect_list(held)).alias("__rows"))
    text = F.array_join(F.transform("__rows", lambda r: r["__piece"]), separator)
    return rows.select(key, (F.left(text, F.lit(limit)) if limit else text).alias(name))


def corpus(files: DataFrame, key: str, order: list[str], name: str, text: str, limit: int = 120_000) -> DataFrame:
    """Per key, '### name' and text of each file that has one, in order, cut to limit."""
    piece = F.concat(F.lit("### "), F.col(name), F.lit("\n"), F.col(text))
    return joined_text(files.filter(F.col(text).isNotNull()), key, order, piece, "\n\n", "corpus", limit)


def bullets(parents: DataFrame, lines: DataFrame, key: str, order: list[str], line: Column, fallback: str) -> DataFrame:
    """Each parent with its lines as '- ' bullets; parents without any get the fallback."""
    listed = joined_text(lines, key, order, F.concat(F.lit("- "), line), "\n", "block")
    return parents.join(listed, key, "left").withColumn("block", F.coalesce("block", F.lit(fallback)))


def required_rows(spark: SparkSession, required: tuple = REQUIRED) -> DataFrame:
    return spark.createDataFrame(list(required), "item_key string, title string, doc_type string")


def checklist(parents: DataFrame, key: str, documents: DataFrame, owner: str, doc_type: str, required: tuple = REQUIRED) -> DataFrame:
    """(key, item_key, title, required, status, note): every required type of every parent, ok if its owner has such a document.

    The required list is a handful of fixed rows; exploding them per parent is no join.
    """
    items = F.array(*[F.struct(F.lit(k).alias("item_key"), F.lit(t).alias("title"), F.lit(d).alias("doc_type")) for k, t, d in required])
    wanted = parents.select(key, F.col(owner).alias("__owner"), F.explode(items).alias("i")).select(key, "__owner", "i.*")
    have = documents.select(F.col(owner).alias("__owner"), F.col(doc_type).alias("doc_type"), F.lit(True).alias("__have")).distinct()
    found = wanted.join(have, ["__owner", "doc_type"], "left")
    ok = F.col("__have").isNotNull()
    status, note = F.when(ok, "ok").otherwise("missing"), F.when(~ok, MISSING_NOTE)
    return found.select(key, "item_key", "title", F.lit(True).alias("required"), status.alias("status"), note.alias("note"))
