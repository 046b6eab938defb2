"""Text functions over whole columns of the driver tables, with values made by rule where those hold no fitting ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import contracts, fields, labels, text
from ledgerloom.operators import texts
from ledgerloom.plans.registry import register
from ledgerloom.session import table

#: DuckDB's class of the white space that text.SPACE means.
_S = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

_FORMATS = [
    ("a.PDF", "text/plain"),
    ("x.zip", "application/pdf"),
    ("noext", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("b.doc", ""),
    ("noext", "application/vnd.ms-excel; charset=binary"),
    ("e.xlsx", "application/zip"),
    ("noext", "application/x-zip-compressed"),
    ("noext", "image/tiff"),
    ("p.html", "text/html"),
    ("d.", ""),
]
_PATHS = ["a.txt", "d/a.txt", "/d//e/a.txt", r"d\e\a.txt", "", "x/y/z/w/v.txt"]
_FIELDS = [
    (1, "tender_no", "НЕТ.", 0.9),
    (2, "tender_no", "  №  1 ", 0.8),
    (3, "tender_no", "н/д", 0.7),
    (4, "nmck", "10% от НМЦК", 0.9),
    (5, "nmck", " 1 000  руб. ", 0.9),
    (6, "guarantees", "Обеспечение заявки и исполнения договора", 0.9),
    (7, "guarantees", "Обеспечение  заявки", 0.9),
    (8, "dates", "до 1 мая; placeholder;30 дней\nне указано", 0.8),
    (9, "delivery_deadline", "30 дней", 0.8),
    (10, "subject", " abc   d ", 1.5),
    (11, "subject", "—", 0.5),
    (12, "mandatory_docs", "Накладная при поставке", 0.9),
    (13, "subject", "abc", 0.74),
    (14, "subject", "abc", 0.75),
]


def _values(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


@register(
    "X3_detect_format",
    f"""
    SELECT page_id, name, mime, CASE
      WHEN ext = 'pdf' OR m = 'application/pdf' THEN 'pdf' WHEN ext = 'docx' OR contains(m, 'wordprocessingml.document') THEN 'docx'
      WHEN ext = 'doc' OR m = 'application/msword' THEN 'doc'
      WHEN ext IN ('xlsx', 'xls') OR contains(m, 'spreadsheetml') OR m = 'application/vnd.ms-excel' THEN 'spreadsheet'
      WHEN ext = 'zip' OR m IN ('application/zip', 'application/x-zip-compressed') THEN 'zip'
      WHEN ext IN ('jpg', 'jpeg', 'png', 'webp', 'gif') OR starts_with(m, 'image/') THEN 'image' ELSE 'unknown' END AS format
    FROM (SELECT *, lower(regexp_extract(name, '[.]([^.]*)$', 1)) AS ext, trim(split_part(lower(mime), ';', 1)) AS m
          FROM (SELECT p.page_id, p.page_id || '-' || n.name AS name, t.mime FROM pages p
                JOIN {_values([(i, n) for i, (n, _) in enumerate(_FORMATS)])} n(i, name) ON n.i = p.page_id % {len(_FORMATS)}
                JOIN {_values([(i, m) for i, (_, m) in enumerate(_FORMATS)])} t(i, mime) ON t.i = p.page_id // {len(_FORMATS)} % {len(_FORMATS)}))
    """,
)
def x3_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, with a name and a MIME type by their number."""
    names, mimes = (F.array(*[F.lit(f[k]) for f in _FORMATS]) for k in (0, 1))
    at = F.col("page_id")
    name = F.concat(at.cast("string"), F.lit("-"), F.element_at(names, (at % len(_FORMATS) + 1).cast("int")))
    mime = F.element_at(mimes, (F.floor(at / len(_FORMATS)) % len(_FORMATS) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), mime.alias("mime"))
    return rows.select("*", text.detect_format(F.col("name"), F.col("mime")).alias("format"))


@register(
    "X1_extension",
    "SELECT page_id, lower(regexp_extract(url, '[.]([^.]*)$', 1)) AS extension, split_part(url, '/', -1) AS base_name FROM pages",
)
def x1_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a URL's last dot and its last slash."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.extension(url).alias("extension"), text.base_name(url).alias("base_name"))


@register(
    "X4_safe_name",
    """
    SELECT page_id, left(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), 180) AS safe,
           left(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), 80) AS safe_short FROM pages
    """,
)
def x4_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(url).alias("safe"), text.safe_name(url, 80).alias("safe_short"))


@register(
    "X5_truncate",
    """
    SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || chr(10) || '...[truncated by EXTRACT_TEXT_MAX_CHARS]' ELSE text END) AS cut_sha256,
           length(CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…' ELSE text END) AS preview_chars FROM documents
    """,
)
def x5_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as it would be kept and shown under a limit of 2000; the cut is the feature."""
    body = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.sha256_hex(text.truncate(body, 2000)).alias("cut_sha256"), F.length(text.preview(body)).cast("long").alias("preview_chars")
    )


@register(
    "X7_path_depth",
    f"""
    SELECT path, greatest(0, len(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda p: p <> '')) - 1) AS depth
    FROM {_values([(p,) for p in _PATHS])} t(path) UNION ALL
    SELECT url, greatest(0, len(list_filter(string_split(replace(url, '\\', '/'), '/'), lambda p: p <> '')) - 1) FROM pages
    """,
)
def x7_path_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string").union(table(spark, sf_dir, "pages").select("url"))
    return paths.select("path", text.path_depth(F.col("path")).cast("long").alias("depth"))


@register(
    "X9_year_month",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month FROM orders",
)
def x9_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.year_month(F.col("o_orderdate")).alias("year_month"))


@register(
    "X10_clamp",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, least(1.0, l_discount * 20 - 0.5)) AS clamped FROM lineitem",
)
def x10_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = text.clamp01(F.col("l_discount") * 20 - 0.5).alias("clamped")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clamped)


@register("X12_kib", "SELECT doc_id, CAST(round(strlen(text) / 1024) AS BIGINT) AS kib FROM documents")
def x12_kib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.kib(F.octet_length("text")).alias("kib"))


@register(
    "X14_hash_and_key",
    """
    SELECT page_id, sha256(html) AS html_sha256,
           concat_ws('/', 'tenders', 'c1', CAST(page_id AS VARCHAR), 'files', 'f1', left(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), 180)) AS storage_key,
           'tender-' || left(sha256(url), 8) || '-export.zip' AS export_name FROM pages
    """,
)
def x14_hash_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys under which a page's file and export would be kept."""
    key = text.record_file_key(F.lit("c1"), F.col("page_id").cast("string"), F.lit("f1"), F.col("url"))
    name = text.export_name(F.sha2("url", 256))
    return table(spark, sf_dir, "pages").select("page_id", text.sha256_hex(F.col("html")).alias("html_sha256"), key.alias("storage_key"), name.alias("export_name"))


@register(
    "X16_prompt",
    """
    SELECT c_custkey, sha256('Составь черновик заявки на участие в закупке на русском языке (структурированный текст с разделами: реквизиты участника, '
      || 'предмет, сроки, соответствие требованиям, подпись).' || chr(10) || 'Участник: ' || c_name
      || CASE WHEN c_mktsegment = 'BUILDING' THEN ', ИНН ' || c_mktsegment ELSE '' END || '.' || chr(10) || 'Закупка: ' || c_mktsegment || '.' || chr(10)
      || 'Описание: —' || chr(10) || 'Ключевые поля из разбора:' || chr(10) || '- a' || chr(10)
      || 'Не выдумывай конкретные номера контрактов, если их нет в данных.') AS prompt_sha256 FROM customer
    """,
)
def x16_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    inn = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment"))
    prompt = text.draft_prompt(F.col("c_name"), inn, F.col("c_mktsegment"), F.lit(None).cast("string"), F.lit("- a"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(prompt, 256).alias("prompt_sha256"))


@register(
    "P6_labels",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Активна' WHEN 'O' THEN 'Черновик' ELSE 'Архив' END AS shown,
           CASE o_orderstatus WHEN 'F' THEN 'Демо' WHEN 'O' THEN 'Старт' ELSE 'other' END AS plan FROM orders
    """,
)
def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status codes shown by label; an unknown plan is shown as it is."""
    status = labels.label(F.col("o_orderstatus"), {"F": "active", "O": "draft", "P": "archived"})
    plan = labels.label(F.col("o_orderstatus"), {"F": "demo", "O": "starter", "P": "other"})
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.label(status, labels.RECORD_STATUS).alias("shown"), labels.label(plan, labels.PLAN, fall_back=True).alias("plan")
    )


_MAPS = {
    name: getattr(labels, name)
    for name in ("SOURCE", "RECORD_STATUS", "FILE_STATUS", "EXTRACTION_STATUS", "DOCUMENT_TYPE", "DOCUMENT_STATUS", "AUDIT_ACTION", "AUDIT_TARGET", "PLAN", "CHECKLIST_STATUS")
}
#: The maps whose unknown codes are shown as they are.
_SHOWN_AS_IS = ("AUDIT_ACTION", "AUDIT_TARGET", "CHECKLIST_STATUS")
_CODED = [(m, i, code) for m, known in _MAPS.items() for i, code in enumerate([*known, "odd"])]


@register(
    "P6_label_maps",
    f"""
    WITH coded AS (SELECT * FROM {_values(_CODED)} t(map, i, code)), shown AS (SELECT * FROM {_values([(m, c, t) for m, known in _MAPS.items() for c, t in known.items()])} t(map, code, label)),
         sizes AS (SELECT map, count(*) AS n FROM coded GROUP BY map)
    SELECT e.event_id, s.map, CASE WHEN l.label IS NOT NULL THEN l.label WHEN s.map IN {_SHOWN_AS_IS} THEN c.code END AS label
    FROM events e CROSS JOIN sizes s JOIN coded c ON c.map = s.map AND c.i = e.event_id % s.n LEFT JOIN shown l ON l.map = c.map AND l.code = c.code
    """,
)
def p6_label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label map, each event holding one of its codes or an unknown one."""

    def shown(name: str) -> Column:
        codes = F.array(*[F.lit(c) for m, _, c in _CODED if m == name])
        code = F.element_at(codes, (F.col("event_id") % F.size(codes) + 1).cast("int"))
        told = labels.audit_target(code) if name == "AUDIT_TARGET" else labels.label(code, _MAPS[name], fall_back=name in _SHOWN_AS_IS)
        return F.struct(F.lit(name).alias("map"), told.alias("label"))

    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*[shown(m) for m in _MAPS])).alias("s"))
    return rows.select("event_id", "s.*")


_CODES = [*labels.ERRORS, *[f" {c} " for c in list(labels.ERRORS)[:5]], "unforeseen", "", *[f"http_{k}" for k in range(398, 516)], "http_", "http_4x"]


@register(
    "P7_user_error",
    f"""
    WITH asked AS (SELECT event_id, c.code FROM events e JOIN {_values(list(enumerate([*_CODES, None])))} c(i, code) ON c.i = e.event_id % {len(_CODES) + 1}),
         known AS (SELECT * FROM {_values(list(labels.ERRORS.items()) + [(f"http_{k}", v) for k, v in labels.HTTP_ERRORS.items()])} t(code, label))
    SELECT a.event_id, CASE WHEN a.code IS NULL OR a.code = '' THEN '' WHEN k.label IS NOT NULL THEN k.label
      WHEN regexp_matches(trim(a.code), '^http_[0-9]+$') THEN 'Ошибка (' || substr(trim(a.code), 6) || ').' ELSE trim(a.code) END AS told
    FROM asked a LEFT JOIN known k ON k.code = trim(a.code)
    """,
)
def p7_user_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user is told of every known code, of HTTP codes known and not, and of other messages."""
    codes = F.array(*[F.lit(c) for c in _CODES], F.lit(None).cast("string"))
    code = F.element_at(codes, (F.col("event_id") % F.size(codes) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.user_error(code).alias("told"))


@register(
    "P5_defaults",
    """
    SELECT conv_id, turn, coalesce(nullif(text, ''), '(none)') AS with_empty, coalesce(nullif(role, 'user'), 'me') AS shown FROM conversations
    """,
)
def p5_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default for null and empty, and one for null only."""
    shown = text.or_default(F.nullif("role", F.lit("user")), "me")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.or_default_if_empty(F.col("text"), "(none)").alias("with_empty"), shown.alias("shown"))


@register(
    "P4_positions",
    "SELECT event_id, i - 1 AS position, string_split(event_type, 'i')[i] AS part FROM (SELECT *, unnest(generate_series(1, len(string_split(event_type, 'i')))) AS i FROM events)",
)
def p4_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries with their places from 0."""
    parts = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.split("event_type", "i", -1)).alias("position", "part"))
    return parts.select("event_id", F.col("position").cast("long").alias("position"), "part")


@register(
    "F8_listed",
    "SELECT c_custkey, lower(c_name) IN ('customer#000000001', 'customer#000000007') OR c_mktsegment = 'BUILDING' AS is_admin FROM customer",
)
def f8_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named in a list, whatever the case, or flagged."""
    flag = F.col("c_mktsegment") == "BUILDING"
    admin = text.listed_or_flagged(F.col("c_name"), " CUSTOMER#000000001 ,, customer#000000007", flag)
    return table(spark, sf_dir, "customer").select("c_custkey", admin.alias("is_admin"))


@register(
    "A7_corpus",
    """
    SELECT conv_id, sha256(left(string_agg('### ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn), 120000)) AS corpus_sha256
    FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
    """,
)
def a7_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text in order of turns."""
    joined = texts.corpus(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text")
    return joined.select("conv_id", F.sha2("corpus", 256).alias("corpus_sha256"))


@register(
    "A8_bullets",
    """
    SELECT c.c_custkey, coalesce(o.block, '(none)') AS block FROM customer c LEFT JOIN (
      SELECT o_custkey, string_agg('- ' || o_orderkey || ': ' || o_orderpriority, chr(10) ORDER BY o_orderdate, o_orderkey) AS block
      FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey
    """,
)
def a8_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's finished orders as a list of bullets, with a fallback for those without."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderpriority"))
    return texts.bullets(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey", ["o_orderdate", "o_orderkey"], line, "(none)")


@register(
    "JSN1_strip_fence",
    """
    WITH o AS (
      SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '```' || props || '```'
                                         WHEN 3 THEN '  ' || props || '```' WHEN 4 THEN '```js  ' || props ELSE chr(10) || '```' || chr(10) || props || '  ```  ' END AS output FROM events
    )
    SELECT event_id, trim(CASE WHEN starts_with(t, '```') THEN regexp_replace(regexp_replace(t, '^```[a-z]*\\s*', ''), '\\s*```$', '') ELSE t END) AS inside
    FROM (SELECT event_id, trim(output, ' ' || chr(10)) AS t FROM o)
    """,
)
def jsn1_strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs made from the events, out of fences that are whole, open, or none."""
    props, fence = F.col("props"), F.lit("```")
    outputs = [
        props,
        F.concat(F.lit("```json\n"), props, F.lit("\n```")),
        F.concat(fence, props, fence),
        F.concat(F.lit("  "), props, fence),
        F.concat(F.lit("```js  "), props),
        F.concat(F.lit("\n```\n"), props, F.lit("  ```  ")),
    ]
    output = F.element_at(F.array(*outputs), (F.col("event_id") % len(outputs) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.strip_code_fence(output).alias("inside"))


#: Outputs by the number of their fault; each holds a confidence of value / 90, which for some is above 1.
FAULTS = 9


@register(
    "JSN2_strict_contract",
    f"""
    WITH e AS (SELECT event_id, event_id % {FAULTS} AS fault, value / 90 AS c, event_type FROM events)
    SELECT event_id, CASE WHEN fault IN (1, 2) THEN 'json_parse_failed' WHEN fault IN (3, 4, 5) OR c NOT BETWEEN 0 AND 1 THEN 'schema_mismatch' ELSE 'ok' END AS status,
           CASE WHEN fault IN (0, 6, 7, 8) AND c BETWEEN 0 AND 1 THEN CASE fault WHEN 7 THEN 'last' ELSE event_type END END AS summary,
           CASE WHEN fault IN (0, 6, 7, 8) AND c BETWEEN 0 AND 1 THEN c END AS confidence
    FROM e
    """,
)
def jsn2_strict_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs made from the events: whole, in a fence, with more keys or a key twice, or broken in one of five ways."""
    told = table(spark, sf_dir, "events").select("event_id", contracts.parse_result(model_output()).alias("r"))
    return told.select("event_id", "r.status", "r.summary", F.col("r.fields")[0]["confidence"].alias("confidence"))


def model_output() -> Column:
    """An event's model output, by its number."""
    confidence = (F.col("value") / 90).cast("string")
    field = F.concat(F.lit('{"key":"k","label":"l","value":"v","confidence":'), confidence, F.lit("}"))
    summary = F.concat(F.lit('"summary":"'), F.col("event_type"), F.lit('"'))
    whole = F.concat(F.lit('{"fields":['), field, F.lit("],"), summary, F.lit("}"))
    outputs = [
        whole,
        F.concat(whole, F.lit(" tail")),
        F.translate(whole, '"', "'"),
        F.replace(whole, F.lit('"k"'), F.lit("1")),
        F.replace(whole, F.lit('"v"'), F.lit("null")),
        F.regexp_replace(whole, '"summary":"[^"]*"', '"other":1'),
        F.concat(F.lit("```json\n"), whole, F.lit("\n```")),
        F.regexp_replace(whole, r"\}$", ',"summary":"last"}'),
        F.regexp_replace(whole, r"\}$", ',"more":[]}'),
    ]
    return F.element_at(F.array(*outputs), (F.col("event_id") % FAULTS + 1).cast("int"))


@register("JSN2_over_events", "SELECT event_id, CASE WHEN json_valid(props) THEN 'schema_mismatch' ELSE 'json_parse_failed' END AS status FROM events")
def jsn2_over_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract over a whole column of valid JSON of another shape."""
    return table(spark, sf_dir, "events").select("event_id", contracts.parse_result(F.col("props"))["status"].alias("status"))


@register(
    "JSN3_pretty_json",
    """
    SELECT o_orderkey, '{' || chr(10) || '  "id": ' || o_orderkey || ',' || chr(10) || '  "title": "' || o_orderpriority || '",' || chr(10) || '  "note": '
           || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',' || chr(10) || '  "items": '
           || CASE WHEN o_orderkey % 2 = 0 THEN '[]' ELSE '[' || chr(10) || '    {' || chr(10) || '      "k": "é\\"' || o_custkey || '"' || chr(10) || '    }' || chr(10) || '  ]' END
           || chr(10) || '}' AS json FROM orders
    """,
)
def jsn3_pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as indented JSON, with nulls, quotes, and a list that may be empty."""
    item = F.array(F.struct(F.concat(F.lit('é"'), F.col("o_custkey").cast("string")).alias("k")))
    items = F.when(F.col("o_orderkey") % 2 == 0, F.slice(item, 1, 0)).otherwise(item)
    note = F.nullif("o_orderstatus", F.lit("F"))
    value = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), note.alias("note"), items.alias("items"))
    return table(spark, sf_dir, "orders").select("o_orderkey", contracts.pretty_json(value).alias("json"))


@register(
    "X13_fixed2",
    """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 40 + (l_partkey % 64) / 64.0 - 900 AS v FROM lineitem),
         r AS (SELECT *, CAST(floor(abs(CAST(v AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS cents FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v < 0 THEN '-' ELSE '' END || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS shown FROM r
    """,
)
def x13_fixed2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in 64ths, many of them exact ties, of either sign and above a thousand, with two decimals."""
    v = F.col("l_quantity").cast("double") * 40 + (F.col("l_partkey") % 64) / 64.0 - 900
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.fixed2(v).alias("shown"))


@register(
    "P2_nested_actor",
    """
    SELECT e.event_id, CASE WHEN c.c_custkey IS NOT NULL THEN '{"id":' || c.c_custkey || ',"name":"' || c.c_name || '"}' END AS actor
    FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_mktsegment = 'BUILDING'
    """,
)
def p2_nested_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their actor as a struct, null as a whole where there is none; shown as JSON."""
    actors = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("actor"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return events.join(actors, events.user_id == actors.c_custkey, "left").select("event_id", F.to_json("actor").alias("actor"))


@register(
    "N1_over_orders",
    f"""
    WITH o AS (SELECT *, o_orderkey % 7 AS k, o_orderkey % 3 AS m, (o_custkey % 28 + 1) || ' мая' AS due FROM orders),
    f AS (
      SELECT o_orderkey, CASE k WHEN 0 THEN 'tender_no' WHEN 1 THEN 'nmck' WHEN 2 THEN 'guarantees' WHEN 3 THEN 'dates' WHEN 4 THEN 'mandatory_docs' ELSE 'subject' END AS key, k, m, due,
        CASE k WHEN 0 THEN CASE m WHEN 0 THEN ' Не   указан. ' WHEN 1 THEN '№  ' || o_orderkey ELSE 'н/д' END
               WHEN 1 THEN CASE m WHEN 0 THEN '10 % от НМЦК' WHEN 1 THEN o_custkey || '   руб.' ELSE '5% обеспечения' END
               WHEN 2 THEN CASE m WHEN 0 THEN 'Обеспечение заявки' WHEN 1 THEN 'Обеспечение заявки и договора' ELSE 'Договор' END
               WHEN 3 THEN 'до ' || o_custkey || '; ' || due || CASE m WHEN 0 THEN ';placeholder' WHEN 1 THEN chr(10) || 'не указано' ELSE '; после ' || due END
               WHEN 4 THEN 'Устав ' || o_custkey || CASE m WHEN 0 THEN '; При поставке накладная 1' WHEN 1 THEN chr(10) || chr(10) || 'Товарная накладная 7' ELSE ';Лицензия' END
               ELSE '  a ' || o_orderpriority || '  b ' END AS value
      FROM o)
    SELECT o_orderkey, key,
      CASE k WHEN 0 THEN CASE m WHEN 1 THEN trim(regexp_replace(value, ' +', ' ', 'g')) ELSE '—' END
             WHEN 3 THEN list_aggregate(list_filter(list_transform(string_split_regex(value, '[;{chr(10)}]'), lambda p: trim(p)), lambda p: p NOT IN ('', due, 'placeholder', 'не указано')), 'string_agg', '; ')
             WHEN 4 THEN list_aggregate(list_filter(list_transform(string_split_regex(value, '[;{chr(10)}]+'), lambda p: trim(p)), lambda p: p <> ''), 'string_agg', chr(10))
             ELSE trim(regexp_replace(value, ' +', ' ', 'g')) END AS value,
      CAST(CASE WHEN k = 0 AND m <> 1 THEN 0.0 WHEN k = 1 AND m <> 1 THEN 0.6 WHEN k = 2 AND m = 1 THEN 0.55 ELSE 0.9 END AS DOUBLE) AS confidence
    FROM f
    """,
)
def n1_over_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields made from the orders by rule, three kinds of value for each key; an order's deadline goes from its dates.

    With the word edges as executed, lines on delivery papers that start with a Cyrillic letter stay.
    """
    k, m = F.col("o_orderkey") % 7, F.col("o_orderkey") % 3
    custkey, orderkey = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    due = F.concat((F.col("o_custkey") % 28 + 1).cast("string"), F.lit(" мая"))

    def pick(by: Column, *values: Column | str) -> Column:
        return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (by + 1).cast("int"))

    subject = F.concat(F.lit("  a "), F.col("o_orderpriority"), F.lit("  b "))
    value = pick(
        k,
        pick(m, " Не   указан. ", F.concat(F.lit("№  "), orderkey), "н/д"),
        pick(m, "10 % от НМЦК", F.concat(custkey, F.lit("   руб.")), "5% обеспечения"),
        pick(m, "Обеспечение заявки", "Обеспечение заявки и договора", "Договор"),
        F.concat(F.lit("до "), custkey, F.lit("; "), due, pick(m, ";placeholder", "\nне указано", F.concat(F.lit("; после "), due))),
        F.concat(F.lit("Устав "), custkey, pick(m, "; При поставке накладная 1", "\n\nТоварная накладная 7", ";Лицензия")),
        subject,
        subject,
    )
    keys = pick(k, "tender_no", "nmck", "guarantees", "dates", "mandatory_docs", "subject", "subject")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("analysis_id"), F.lit(0).alias("sort_order"), keys.alias("key"), value.alias("value"), F.lit(0.9).alias("confidence"))
    deadlines = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("analysis_id"), F.lit(1).alias("sort_order"), F.lit("delivery_deadline").alias("key"), due.alias("value"), F.lit(0.9).alias("confidence"))
    return fields.normalize_fields(rows.unionByName(deadlines)).filter("sort_order = 0").select("o_orderkey", "key", "value", "confidence")


@register(
    "N1_normalize",
    f"""
    WITH f AS (SELECT e.event_id, t.key, t.value, t.confidence FROM events e JOIN {_values(_FIELDS)} t(id, key, value, confidence) ON t.id = e.event_id % {len(_FIELDS)} + 1),
    g AS (SELECT *, trim(regexp_replace(value, '{_S}+', ' ', 'g')) AS light, least(1.0, CAST(confidence AS DOUBLE)) AS c,
                 regexp_matches(trim(value), '(?i)^(нет|не{_S}+указан|не{_S}+найден|н/д|n/a|отсутствует)\\.?$') AS gone FROM f)
    SELECT event_id, key, CASE WHEN key = 'tender_no' AND gone THEN '—'
             WHEN key = 'dates' THEN array_to_string([p FOR p IN [trim(x) FOR x IN string_split_regex(value, '[;{chr(10)}]')] IF p NOT IN ('', '30 дней', 'placeholder', 'не указано')], '; ') ELSE light END AS value,
           CASE WHEN key = 'tender_no' AND gone THEN 0.0 WHEN key = 'nmck' AND contains(light, '% от') THEN 0.6
                WHEN key = 'guarantees' AND contains(light, 'исполнен') THEN 0.55 ELSE c END AS confidence FROM g
    """,
)
def n1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of each event's analysis by its number, with a deadline beside it whose value goes from the dates."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("analysis_id"))
    own = events.withColumn("sort_order", F.lit(0)).select("*", _listed_field(F.col("event_id")).alias("f"))
    rows = own.select("event_id", "analysis_id", "sort_order", "f.key", "f.value", "f.confidence")
    due = events.select("*", F.lit(1).alias("sort_order"), F.lit("delivery_deadline").alias("key"), F.lit("30 дней").alias("value"), F.lit(0.8).alias("confidence"))
    return fields.normalize_fields(rows.unionByName(due)).filter("sort_order = 0").select("event_id", "key", "value", "confidence")


def _listed_field(number: Column) -> Column:
    """One of _FIELDS by a number, as struct<key, value, confidence>."""
    told = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"), F.lit(c).alias("confidence")) for _, k, v, c in _FIELDS]
    return F.element_at(F.array(*told), (number % len(_FIELDS) + 1).cast("int"))


@register(
    "N7_badge",
    f"""
    SELECT o_orderkey, CASE WHEN trim(value) IN ('', '—', '-', '–') THEN 'Не найдено' WHEN contains(value, '%') OR contains(value, 'placeholder') THEN 'Вычислено'
      WHEN key = 'guarantees' AND contains(value, 'исполнен') THEN 'Смешанные данные' WHEN confidence < 0.75 THEN 'Требует проверки' END AS badge
    FROM (SELECT o.o_orderkey, t.key, CASE WHEN o.o_custkey % 5 = 0 THEN ' - ' ELSE t.value END AS value, CASE WHEN o.o_custkey % 3 = 0 THEN 0.74 ELSE t.confidence END AS confidence
          FROM orders o JOIN {_values(_FIELDS)} t(id, key, value, confidence) ON t.id = o.o_orderkey % {len(_FIELDS)} + 1)
    """,
)
def n7_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark of a field made from each order, some of them emptied or made doubtful."""
    shown = table(spark, sf_dir, "orders").withColumn("f", _listed_field(F.col("o_orderkey")))
    value = F.when(F.col("o_custkey") % 5 == 0, " - ").otherwise(F.col("f.value"))
    confidence = F.when(F.col("o_custkey") % 3 == 0, 0.74).otherwise(F.col("f.confidence"))
    return shown.select("o_orderkey", fields.badge(F.col("f.key"), value, confidence).alias("badge"))


@register(
    "F9_valid_record",
    """
    SELECT doc_id, coalesce(length(text) BETWEEN 1 AND 300, false) AS valid_title,
           coalesce(length(text) BETWEEN 1 AND 300, false) AND source <> 'src0' AS valid_record FROM documents
    """,
)
def f9_valid_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as titles of new records; those of one source would need a URL that they lack."""
    kind = F.when(F.col("source") == "src0", "url").otherwise("manual")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", contracts.within(F.col("text"), 1, 300).alias("valid_title"), contracts.valid_record(F.col("text"), none, kind, none).alias("valid_record")
    )


@register(
    "X20_gateway",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'gpt-5-nano' WHEN 'click' THEN 'gpt-5-mini' WHEN 'error' THEN 'gpt-5.4-mini' END AS model,
           CASE WHEN event_type = 'error' THEN 'rejected' WHEN value < 50 THEN 'not_configured' ELSE 'accepted' END AS verdict FROM events
    """,
)
def x20_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes to models, and what a gateway decides before a call."""
    route = labels.label(F.col("event_type"), {"view": "nano", "click": "mini", "error": "escalate"})
    sensitivity = F.when(F.col("event_type") == "error", "too_much_pii").otherwise("public")
    return table(spark, sf_dir, "events").select(
        "event_id", text.model_for_route(route).alias("model"), text.gateway_verdict(sensitivity, F.col("value") >= 50).alias("verdict")
    )
