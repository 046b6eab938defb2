"""Line dedup: drop lines that an earlier document already holds, told as run-length keep bitmaps.

Only DataFrame functions. Lines become two 64-bit hashes (128 bits: two different lines sharing both is not a practical
case even for 10^12 lines). The hashes are range-partitioned, sorted by document and position inside each range, and the first
occurrence per document is streamed from the order. A very common line is spread over many ranges by a document salt, its
firsts are combined map-side, and the join back to the lines is a plain equi-join that AQE may split; so no task has to hold
a hot line. Text is read twice and moved once, at the very end, to be cut.

Defined results: null text counts as empty, which is one empty line. A null doc_id sorts after all others. Rows that repeat a
doc_id are one document; each still gets its own row. Lines under min_chars always stay. Of a line that a document holds several times,
all go or none. Very long texts count whole; their lines are cut in one task. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = 9223372036854775807
_SALTS = 1024


def lower_ascii(c: Column) -> Column:
    """A-Z lowered, all else kept; lower() is quicker and equal where no other upper-case letter can be."""
    return F.when(c.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(c, _UPPER, _LOWER)).otherwise(F.lower(c))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, ord, pos, h1, h2) for each line whose key has min_chars code points; th tells apart rows of one doc_id."""
    lines = _rows(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    order = F.coalesce("doc_id", F.lit(_LAST))
    return keyed.select("doc_id", "th", order.alias("ord"), "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def first_occurrences(lines: DataFrame, partitions: int) -> DataFrame:
    """(h1, h2, first) of the hashes that at least two documents hold."""
    salted = lines.select("h1", "h2", F.pmod(F.xxhash64("ord"), F.lit(_SALTS)).alias("salt"), "ord", "pos")
    ranged = salted.repartitionByRange(partitions, "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy("ord", "pos")
    before = F.lag("ord").over(order)
    firsts = ranged.withColumn("before", before).filter("before IS NULL OR before <> ord")
    return firsts.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, drops): for each document row that loses lines, its dropped runs as sorted (start, length)."""
    spark = docs.sparkSession
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = written(first_occurrences(lines, partitions), "line-firsts")
    later = lines.join(firsts, ["h1", "h2"]).filter("ord > first").select("doc_id", "th", "pos")
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "th").orderBy("pos"))
    runs = later.withColumn("island", island).groupBy("doc_id", "th", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    run = F.struct("start", (F.col("end") - F.col("start") + 1).alias("len"))
    return runs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(run)).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document row with its dropped runs cut out."""
    rows, b = _rows(docs), bitmaps.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"), "drops")
    same = rows.doc_id.eqNullSafe(b.b_id) & (rows.th == b.b_th)
    joined = rows.join(b, same, "left").select("doc_id", "text", "drops")
    lines = F.split("text", "\n", -1)
    ends = F.concat(F.array(F.lit(0)), F.transform("drops", lambda r: r["start"] + r["len"]))
    starts = F.concat(F.transform("drops", lambda r: r["start"]), F.array(F.size(lines)))
    split = joined.withColumn("lines", lines).withColumn("keeps", F.arrays_zip(ends.alias("s"), starts.alias("e")))
    kept = F.flatten(F.transform("keeps", lambda k: F.slice(F.col("lines"), k["s"] + 1, k["e"] - k["s"])))
    dropped = F.aggregate("drops", F.lit(0).cast("long"), lambda a, r: a + r["len"].cast("long"))
    return split.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Each document with the lines it keeps: (doc_id, n_lines, n_dropped, text)."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
