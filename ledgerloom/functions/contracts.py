"""Checks of rows and JSON at the boundary."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip_code_fence, trim

RESULT_TYPE = "status string, summary string, fields array<struct<key:string,label:string,value:string,confidence:double>>"


def _no_constant(name: str):
    raise ValueError(name)


def check_result(raw: str | None) -> dict:
    """The contract of one analysis result: strict JSON, four typed keys in each field, a summary; other keys are dropped."""
    bad = {"status": "schema_mismatch", "summary": None, "fields": None}
    try:
        data = json.loads(raw or "", parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return bad | {"status": "json_parse_failed"}
    if not isinstance(data, dict) or not isinstance(data.get("fields"), list) or not isinstance(data.get("summary"), str):
        return bad
    fields = []
    for field in data["fields"]:
        if not isinstance(field, dict) or not all(isinstance(field.get(k), str) for k in ("key", "label", "value")):
            return bad
        confidence = field.get("confidence")
        if isinstance(confidence, bool) or not isinstance(confidence, int | float) or not 0 <= confidence <= 1:
            return bad
        fields.append({"key": field["key"], "label": field["label"], "value": field["value"], "confidence": float(confidence)})
    return {"status": "ok", "summary": data["summary"], "fields": fields}


def _checked(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    # No JVM function is strict enough: they coerce types, take single quotes or NaN, or let text follow the value.
    for batch in raw:
        yield pd.DataFrame([check_result(r) for r in batch], columns=["status", "summary", "fields"])


def parse_result(output: Column) -> Column:
    """A model's output as struct<status, summary, fields>; a code fence around it is taken off."""
    return F.pandas_udf(_checked, RESULT_TYPE)(strip_code_fence(output))


def within(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(c).between(low, high), F.lit(False))


def valid_record(title: Column, description: Column, source_type: Column, source_url: Column) -> Column:
    """A new record: title of 1 to 300, description up to 8000, and a URL exactly where the source needs one."""
    url = source_url.isNull() | (source_url == "") | source_url.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^\s]+\z")
    linked = (source_type != "url") | (source_url.isNotNull() & (source_url != ""))
    described = description.isNull() | (F.length(description) <= 8000)
    return within(title, 1, 300) & described & url & F.coalesce(linked, F.lit(False))


def valid_company(name: Column, inn: Column, kpp: Column, ogrn: Column) -> Column:
    """A new company: name of 2 to 200; numbers, trimmed, of their lengths or empty."""

    def number(c: Column, low: int, high: int) -> Column:
        t = trim(F.coalesce(c, F.lit("")))
        return (t == "") | F.length(t).between(low, high)

    return within(name, 2, 200) & number(inn, 10, 12) & number(kpp, 9, 9) & number(ogrn, 13, 15)


def valid_document(kind: Column, title: Column, kinds: list[str]) -> Column:
    return F.coalesce(kind.isin(*kinds), F.lit(False)) & within(title, 2, 200)


def valid_gateway_request(route: Column, prompt: Column, max_tokens: Column) -> Column:
    """Known route (mini by default), a prompt, and 1 to 4096 tokens (800 by default)."""
    tokens = F.coalesce(max_tokens, F.lit(800))
    return F.coalesce(route, F.lit("mini")).isin("nano", "mini", "escalate") & within(prompt, 1, 2**31 - 1) & tokens.between(1, 4096)


def valid_upload(size: Column, limit: int) -> Column:
    return F.coalesce((size > 0) & (size <= limit), F.lit(False))


def _indented(raw: pd.Series) -> pd.Series:
    whole = lambda text: int(float(text)) if float(text).is_integer() and abs(float(text)) < 1e21 else float(text)
    return raw.map(lambda r: None if r is None else json.dumps(json.loads(r, parse_float=whole), ensure_ascii=False, indent=2))


def pretty_json(value: Column) -> Column:
    """JSON with two-space indents, each list entry on a line of its own; null fields are written, whole numbers without a fraction."""
    # The JVM's pretty printer puts a space before colons and leaves lists on one line.
    return F.pandas_udf(_indented, "string")(F.to_json(value, {"ignoreNullFields": "false"}))
