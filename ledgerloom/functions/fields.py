"""Rules for the fields of an analysis, and the badge a field gets.

As executed, the word edges in these rules know ASCII letters only, so beside a Cyrillic letter they match just where an ASCII
word character stands on the other side. That is the default; unicode_edges=True takes edges as evidently meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE as S
from ledgerloom.functions.text import clamp01, collapse, trim

_ASCII_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: The patterns of the rules.
MISSING = rf"(?iu)\A(нет|не{S}+указан|не{S}+найден|н/д|n/a|отсутствует)\.?\z"
DASHES = ("", "—", "-", "–")
INDIRECT = rf"выведен|косвенн|placeholder|%{S}*от|от{S}+нмцк|процент{S}+от"
SECURITY_SHARE = "обеспеч|заявк|гарант"
SECURITY = "обеспеч"
APPLICATION = "заявк|участник|допуск"
EXECUTION = "исполнен|договор|контракт|поставк"
DELIVERY = rf"при{S}+(поставке|передаче|отгрузке)"
DELIVERY_NOTE = rf"товарн(ая)?{S}+накладная"
TRANSFER_PAPER = rf"универсальн(ый|ого|ая)?{S}+передаточн"
TRANSFER_SHORT, TRANSFER_USE = "упд", "поставк|передач|отгрузк"
SHORT_LINE, LONG_LINE = 55, 120
TAIL_MARKS = ("[,;]", "[—–-]")
JUNK_DATE = rf"(?iu)\A(placeholder|выведено?|не{S}+указан[оы]?|не{S}+заполнен[оы]?|n/a|[—–-])\z"


def _edge(unicode_edges: bool) -> str:
    return r"\b" if unicode_edges else _ASCII_EDGE


def missing_number(value: Column) -> Column:
    t = trim(value)
    return t.isin(*DASHES) | t.rlike(MISSING)


def indirect_price(value: Column) -> Column:
    low = F.lower(value)
    return low.rlike(INDIRECT) | (F.contains(low, F.lit("%")) & low.rlike(SECURITY_SHARE))


def mixed_guarantees(value: Column) -> Column:
    low = F.lower(value)
    return low.rlike(SECURITY) & low.rlike(APPLICATION) & low.rlike(EXECUTION)


def required_documents(value: Column, unicode_edges: bool = False) -> Column:
    """One document a line: split at newlines and semicolons, short lines about delivery papers dropped, tails of long ones cut."""
    e = _edge(unicode_edges)
    lines = F.flatten(F.transform(F.split(value, r"\n+", -1), lambda block: F.split(block, rf";{S}*(?=(?!{S})(?s:.))", -1)))
    trimmed = F.filter(F.transform(lines, trim), lambda t: t != "")

    def delivery_only(t: Column) -> Column:
        note = t.rlike(rf"(?iu)\A{DELIVERY_NOTE}{e}")
        transfer = t.rlike(rf"(?iu)\A{TRANSFER_PAPER}")
        upd = t.rlike(rf"(?iu)\A{TRANSFER_SHORT}{e}") & t.rlike(rf"(?iu){e}({TRANSFER_USE}){e}")
        short = (F.length(t) < SHORT_LINE) & t.rlike(rf"(?iu)\A{S}*{DELIVERY}{e}")
        return (F.length(t) <= LONG_LINE) & (note | transfer | upd | short)

    def without_tail(t: Column) -> Column:
        for mark in TAIL_MARKS:
            t = F.regexp_replace(t, rf"(?iu){S}*{mark}{S}*{DELIVERY}{e}[^.;]*\z", "")
        return trim(t)

    def cut(t: Column) -> Column:
        long = (F.length(t) > LONG_LINE) & t.rlike(rf"(?iu){e}{DELIVERY}{e}")
        return F.when(long & (without_tail(t) != ""), without_tail(t)).otherwise(t)

    kept = F.transform(F.filter(trimmed, lambda t: ~delivery_only(t)), cut)
    return trim(F.array_join(kept, "\n"))


def clean_dates(value: Column, deadline: Column) -> Column:
    """The dates' segments without empty and junk ones and without the delivery deadline, joined by '; '."""
    parts = F.transform(F.split(value, rf"\n+|;{S}*(?=(?!{S})(?s:.))", -1), trim)
    due = trim(F.coalesce(deadline, F.lit("")))
    kept = F.filter(parts, lambda p: (p != "") & ~p.rlike(JUNK_DATE) & ((due == "") | (p != due)))
    return trim(F.regexp_replace(F.array_join(kept, "; "), rf";{S}*;", "; "))


def normalize_fields(fields: DataFrame, unicode_edges: bool = False) -> DataFrame:
    """Fields (analysis_id, sort_order, key, label, value, confidence) with value and confidence by the rule of their key.

    The dates rule looks at the analysis's delivery_deadline; of several the last counts.
    """
    last = F.max(F.when(F.col("key") == "delivery_deadline", F.struct("sort_order", "value"))).over(Window.partitionBy("analysis_id"))
    key, value, c = F.col("key"), F.col("value"), clamp01(F.col("confidence"))
    gone = (key == "tender_no") & missing_number(value)
    light = collapse(value)
    new_value = (
        F.when(gone, "—")
        .when(key == "mandatory_docs", required_documents(value, unicode_edges))
        .when(key == "dates", clean_dates(value, F.col("__due")["value"]))
        .otherwise(light)
    )
    new_confidence = (
        F.when(gone, 0.0)
        .when((key == "nmck") & indirect_price(light), F.least(c, F.lit(0.6)))
        .when((key == "guarantees") & mixed_guarantees(light), F.least(c, F.lit(0.55)))
        .otherwise(c)
    )
    return fields.withColumn("__due", last).withColumns({"value": new_value, "confidence": new_confidence}).drop("__due")


def badge(key: Column, value: Column, confidence: Column, unicode_edges: bool = False) -> Column:
    """What a field's row is marked with; the first that fits, null for none."""
    t = trim(F.coalesce(value, F.lit("")))
    low, e = F.lower(t), _edge(unicode_edges)
    derived = low.rlike(INDIRECT) | ((key == "nmck") & F.contains(low, F.lit("%")))
    mixed = ((key == "guarantees") & mixed_guarantees(t)) | ((key == "mandatory_docs") & t.rlike(rf"(?iu){e}{DELIVERY}{e}"))
    return F.when(t.isin(*DASHES), "Не найдено").when(derived, "Вычислено").when(mixed, "Смешанные данные").when(confidence < 0.75, "Требует проверки")
