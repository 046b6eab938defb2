"""Text functions over columns. Lengths and cuts count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming and \s mean here (tabs to carriage return, space, NBSP, Unicode spaces, BOM).
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRUNCATION_MARK = "\n\n...[truncated by EXTRACT_TEXT_MAX_CHARS]"

#: Formats in the order in which their rules are tried; the first whose extension or MIME type fits wins.
FORMAT_RULES = (
    ("pdf", ("pdf",), r"^application/pdf$"),
    ("docx", ("docx",), r"wordprocessingml\.document"),
    ("doc", ("doc",), r"^application/msword$"),
    ("spreadsheet", ("xlsx", "xls"), r"spreadsheetml|^application/vnd\.ms-excel$"),
    ("zip", ("zip",), r"^application/(zip|x-zip-compressed)$"),
    ("image", ("jpg", "jpeg", "png", "webp", "gif"), r"^image/"),
)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[.]([^.]*)\z", 1))


def mime_type(mime: Column) -> Column:
    return trim(F.substring_index(F.lower(mime), ";", 1))


def detect_format(name: Column, mime: Column) -> Column:
    ext, kind = extension(name), mime_type(F.coalesce(mime, F.lit("")))
    out = F.lit("unknown")
    for label, extensions, pattern in reversed(FORMAT_RULES):
        out = F.when(ext.isin(*extensions) | kind.rlike(pattern), label).otherwise(out)
    return out


def safe_name(name: Column, limit: int = 180) -> Column:
    """Runs of characters outside letters, digits, dot, underscore and hyphen become one underscore."""
    return F.left(F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "_"), F.lit(limit))


def truncate(text: Column, limit: int, mark: str = TRUNCATION_MARK) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def preview(text: Column, limit: int = 2000) -> Column:
    return truncate(text, limit, "…")


def path_depth(path: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: p != "")
    return F.greatest(F.lit(0), F.size(parts) - 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def year_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def kib(size: Column) -> Column:
    return F.round(size / 1024).cast("long")


def fixed2(x: Column) -> Column:
    """Two decimals, without thousands separators, rounding the exact binary value, ties away from 0; for values below 10^15.

    Exact ties are the odd multiples of an eighth; format_number would round those to even, so they are moved off the tie.
    """
    tie = F.abs(F.pmod(x * 8, F.lit(2.0))) == 1.0
    return F.replace(F.format_number(F.when(tie, x + F.signum(x) * 0.001).otherwise(x), 2), F.lit(","), F.lit(""))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def object_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def record_file_key(company: Column, record: Column, file: Column, name: Column) -> Column:
    return object_key("tenders", company, record, "files", file, safe_name(name))


def document_version_key(company: Column, document: Column, version: Column, name: Column) -> Column:
    return object_key("companies", company, "documents", document, "versions", version, safe_name(name))


def export_name(record_id: Column) -> Column:
    return F.concat(F.lit("tender-"), F.left(record_id, F.lit(8)), F.lit("-export.zip"))


def strip_code_fence(text: Column) -> Column:
    """The inside of a fenced block, where the text starts with a fence; else the trimmed text."""
    t = trim(text)
    opened = F.regexp_replace(t, rf"\A```[a-zA-Z0-9]*{SPACE}*", "")
    closed = F.regexp_replace(opened, rf"(?ms)\A(.*?){SPACE}*```{SPACE}*$", "$1")
    return F.when(t.startswith("```"), trim(closed)).otherwise(t)


def or_default(value: Column, default: Column | str) -> Column:
    """default for null only."""
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default)


def or_default_if_empty(value: Column, default: Column | str | None) -> Column:
    """default for null and the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def listed_or_flagged(email: Column, listing: str, flag: Column) -> Column:
    """Whether a comma-separated list holds the address, whatever its case, or the flag is set."""
    entries = F.filter(F.transform(F.split(F.lit(listing), ","), lambda e: F.lower(trim(e))), lambda e: e != "")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.array_contains(entries, F.lower(email)), F.lit(False))


#: The models by route.
MODELS = {"nano": "gpt-5-nano", "mini": "gpt-5-mini", "escalate": "gpt-5.4-mini"}


def model_for_route(route: Column) -> Column:
    return F.coalesce(*[F.when(route == k, v) for k, v in MODELS.items()])


def gateway_verdict(sensitivity: Column, configured: Column) -> Column:
    """Too much personal data is refused before the missing configuration is noticed."""
    return F.when(sensitivity == "too_much_pii", "rejected").when(~configured, "not_configured").otherwise("accepted")


#: The wording of the request for a draft, in its parts.
PROMPT = (
    "Составь черновик заявки на участие в закупке на русском языке (структурированный текст с разделами: реквизиты участника, "
    "предмет, сроки, соответствие требованиям, подпись).\nУчастник: ",
    ".\nЗакупка: ",
    ".\nОписание: ",
    "\nКлючевые поля из разбора:\n",
    "\nНе выдумывай конкретные номера контрактов, если их нет в данных.",
)


def draft_prompt(company: Column, inn: Column, title: Column, description: Column, fields: Column) -> Column:
    """The request text for a draft application; the INN part is left out where there is none."""
    who = F.concat(F.coalesce(company, F.lit("Компания")), F.when(F.coalesce(inn, F.lit("")) != "", F.concat(F.lit(", ИНН "), inn)).otherwise(""))
    start, title_mark, description_mark, fields_mark, end = (F.lit(p) for p in PROMPT)
    return F.concat(start, who, title_mark, title, description_mark, F.coalesce(description, F.lit("—")), fields_mark, fields, end)
