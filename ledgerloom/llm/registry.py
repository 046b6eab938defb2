"""The numbered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, bpe, clustering, decontamination, line_dedup, media, mixing, near_dedup, quality, secrets, sharding, token_counts, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.train_and_score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumn("held_out", quality.held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_docs(spark, sf_dir), secrets.train(secrets.labelled_samples(spark)))
    counts = [secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each page's visible text is rendered as one, whole, and those are the media column."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("media_id"), media.visible_text().alias("value"))
    return media.copy_classes(pages, media.render_column).select(F.col("media_id").alias("page_id"), "class_id")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "class_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_docs(spark, sf_dir), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_docs(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, h, min(page_id) OVER (PARTITION BY h) AS first,
         [CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) FOR k IN generate_series(0, 7)] AS v FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(q + 1 AS BIGINT), 1)
                        FOR q IN flatten([[x // 32768, x // 1024 % 32, x // 32 % 32, x % 32] FOR x IN v])], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judge(decontamination.find_overlaps(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    named = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named, "contaminated")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bi AS (
  SELECT item, ws, least(len(ws), 13) AS n, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM bi
), ns AS (
  SELECT DISTINCT n FROM bw
), di AS (
  SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, ns WHERE len(ws) >= n
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM di
), occ AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""

OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id > f.first AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids' table has 40 rows at most, so it is broadcast to the vectors."""
    found = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = found.centroids.agg(clustering.long_sum("inertia").alias("inertia")).scalar()
    told = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    centroids = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), told.alias("centroid_sha256"))
    joined = found.assigned.join(F.broadcast(centroids), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round."""
    nearest = """
    SELECT rid, any_value(vec_id) AS vec_id, arg_min(c, [d, c]) AS c, min(d) AS d FROM (
      SELECT v.rid, v.vec_id, c.c, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.v, c.v)]) AS BIGINT) AS d FROM kept v, {centroids} c
    ) GROUP BY rid"""
    steps = [
        """kept AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds):
        steps += [
            f"a{n} AS MATERIALIZED ({nearest.format(centroids=f'c{n}')})",
            f"""s{n} AS MATERIALIZED (
      SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM (
        SELECT a.c, u.i, CAST(sum(u.x) AS BIGINT) AS s, count(*) AS n
        FROM a{n} a JOIN (SELECT rid, unnest(v) AS x, unnest(generate_series(1, 64)) AS i FROM kept) u ON u.rid = a.rid GROUP BY a.c, u.i) GROUP BY c
    )""",
            f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.v, o.v) AS v FROM c{n} o LEFT JOIN s{n} s ON s.c = o.c)",
        ]
    return f"""WITH {", ".join([*steps, f"f AS MATERIALIZED ({nearest.format(centroids=f'c{rounds}')})"])}
    SELECT f.vec_id, CAST(f.c AS INTEGER) AS cluster, f.d AS distance, CAST(sum(f.d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM f JOIN c{rounds} c ON c.c = f.c"""


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(_docs(spark, sf_dir), path), path)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(_docs(spark, sf_dir), *paths, as_digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256").fillna({"groups_sha256": ""})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality": op2_quality,
        "op3_token_counts": op3_token_counts,
        "op4_secrets": op4_secrets,
        "op5_media": op5_media,
        "op6_near_dedup": op6_near_dedup,
        "op7_sharding": op7_sharding,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_decontamination": op10_decontamination,
        "op11_clustering": op11_clustering,
        "op12_bpe": op12_bpe,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_clustering": _op11_sql()}
