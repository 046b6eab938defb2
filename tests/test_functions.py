"""Case tables derived from the rules by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import contracts, fields, labels, text
from ledgerloom.operators import reads, usage
from ledgerloom.sources import settings


def values(spark, cases, columns, expression):
    rows = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], f"i int, {columns}")
    return [r.v for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


def check(spark, cases, columns, expression):
    assert values(spark, cases, columns, expression) == [c[-1] for c in cases]


def test_white_space(spark):
    check(spark, [(" ﻿ a  ", "a"), ("\x85a", "\x85a"), ("", ""), (" \n\t", ""), (None, None)], "t string", text.trim(F.col("t")))
    check(spark, [("a  \n b", "a b"), (" x", "x")], "t string", text.collapse(F.col("t")))


def test_paths_and_names(spark):
    check(spark, [("a.txt", 0), ("d/a.txt", 1), ("/d//e/a.txt", 2), ("d\\e\\a.txt", 2), ("", 0)], "p string", text.path_depth(F.col("p")))
    check(spark, [("a.b.PDF", "pdf"), ("noext", ""), ("d.", ""), (".env", "env")], "p string", text.extension(F.col("p")))
    check(spark, [("тест a.b", "_a.b"), ("x" * 200, "x" * 180), ("", "")], "p string", text.safe_name(F.col("p")))
    check(spark, [("d\\e/a", "a"), ("a", "a")], "p string", text.base_name(F.col("p")))
    safe = text.safe_name(F.col("p"))
    again = values(spark, [("a  ж/b?.txt", 0), ("--__", 0)], "p string", text.safe_name(safe) == safe)
    assert again == [True, True]


def test_cuts(spark):
    check(spark, [("abc", "abc"), ("abcd", "abc" + text.TRUNCATION_MARK), (None, None)], "t string", text.truncate(F.col("t"), 3))
    check(spark, [("abc", "abc"), ("abcd", "abc…")], "t string", text.preview(F.col("t"), 3))


def test_numbers(spark):
    check(spark, [(-1.0, 0.0), (0.5, 0.5), (2.0, 1.0), (float("nan"), 0.0)], "x double", text.clamp01(F.col("x")))
    check(spark, [(0.745, "0.74"), (0.995, "0.99"), (0.125, "0.13"), (0.375, "0.38"), (0.625, "0.63"), (0.875, "0.88"), (1.0, "1.00"), (0.0, "0.00"), (1.125, "1.13"), (1234.5, "1234.50"), (2.625, "2.63"), (1.005, "1.00"), (-0.125, "-0.13"), (1e6 + 0.375, "1000000.38")], "x double", text.fixed2(F.col("x")))
    check(spark, [(512, 1), (2560, 3), (0, 0)], "n int", text.kib(F.col("n")))


def test_months_at_their_edges(spark):
    stamp = datetime.datetime
    check(spark, [(stamp(2024, 1, 31, 23, 59, 59, 999000), "2024-01"), (stamp(2024, 2, 1), "2024-02")], "t timestamp_ntz", text.year_month(F.col("t")))


def test_errors_and_labels(spark):
    cases = [("login_failed", "Не удалось войти."), (" http_404 ", "Не найдено."), ("http_599", "Ошибка (599)."), (" other ", "other"), ("", ""), (None, "")]
    check(spark, cases, "c string", labels.user_error(F.col("c")))
    check(spark, [("ok", "выполнено"), ("odd", "odd")], "c string", labels.label(F.col("c"), labels.CHECKLIST_STATUS, fall_back=True))
    check(spark, [("Tender", "Закупка"), ("User", "User"), (None, "—")], "c string", labels.audit_target(F.col("c")))


@pytest.mark.parametrize(
    "raw,status",
    [
        ('{"fields":[],"summary":"s"}', "ok"),
        ('{"fields":[{"key":"k","label":"l","value":"v","confidence":0}],"summary":""}', "ok"),
        ('{"fields":[{"key":"k","label":"l","value":"v","confidence":-0.1}],"summary":""}', "schema_mismatch"),
        ('{"fields":{},"summary":"s"}', "schema_mismatch"),
        ("[]", "schema_mismatch"),
        ('{"fields":[],"summary":"s"} x', "json_parse_failed"),
        ('{"fields":[],"summary":Infinity}', "json_parse_failed"),
        ("", "json_parse_failed"),
        (None, "json_parse_failed"),
        ("[" * 100_000, "json_parse_failed"),
    ],
)
def test_contract(raw, status):
    assert contracts.check_result(raw)["status"] == status


def test_contract_keeps_known_keys_and_the_last_of_a_name(spark):
    raw = '```json\n{"summary":"a","fields":[{"key":"k","label":"l","value":"v","confidence":1,"more":2}],"summary":"b"}\n```'
    got = spark.createDataFrame([(raw,)], "o string").select(contracts.parse_result(F.col("o")).alias("r")).first().r
    assert got.summary == "b" and got.fields[0].asDict() == {"key": "k", "label": "l", "value": "v", "confidence": 1.0}


def test_fences(spark):
    cases = [("```json\n{}\n```", "{}"), ("```\na\n```\nb\n```", "a\n\nb\n```".replace("\n\nb", "\nb")), (" {} ", "{}"), ("a ```b```", "a ```b```"), (None, None)]
    got = values(spark, cases, "t string", text.strip_code_fence(F.col("t")))
    assert got[0] == "{}" and got[2:] == ["{}", "a ```b```", None] and got[1].startswith("a") and got[1].endswith("```")


def test_field_rules(spark):
    check(spark, [("НЕТ.", True), ("н/д", True), ("Не  указан", True), ("—", True), ("№ 1", False), ("нету", False)], "v string", fields.missing_number(F.col("v")))
    check(spark, [("Обеспечение заявки и исполнения договора", True), ("обеспечение заявки", False)], "v string", fields.mixed_guarantees(F.col("v")))
    check(spark, [("a;b\n\nc ; d", "a\nb\nc\nd"), ("товарная накладная", "товарная накладная"), ("универсальный передаточный документ", "")], "v string", fields.required_documents(F.col("v")))
    check(spark, [("товарная накладная; устав", "устав")], "v string", fields.required_documents(F.col("v"), unicode_edges=True))
    cases = [("subject", "", 0.9, "Не найдено"), ("subject", "—", 0.9, "Не найдено"), ("nmck", "10%", 0.9, "Вычислено"), ("guarantees", "Обеспечение заявки и исполнения договора", 0.9, "Смешанные данные")]
    cases += [("mandatory_docs", "Накладная при поставке", 0.9, None), ("subject", "abc", 0.74, "Требует проверки"), ("subject", "abc", 0.75, None)]
    check(spark, cases, "k string, v string, c double", fields.badge(F.col("k"), F.col("v"), F.col("c")))
    marked = values(spark, [("mandatory_docs", "Накладная при поставке", 0.9, None)], "k string, v string, c double", fields.badge(F.col("k"), F.col("v"), F.col("c"), unicode_edges=True))
    assert marked == ["Смешанные данные"]


def test_deadline_goes_from_the_dates_and_the_last_one_counts(spark):
    rows = [(1, 0, "dates", "5 мая; 30 дней; placeholder", 0.9), (1, 1, "delivery_deadline", "5 мая", 0.9), (1, 2, "delivery_deadline", "30 дней", 0.9), (2, 0, "dates", "30 дней", 2.0)]
    df = spark.createDataFrame(rows, "analysis_id int, sort_order int, key string, value string, confidence double")
    got = {(r.analysis_id, r.sort_order): (r.value, r.confidence) for r in fields.normalize_fields(df).collect()}
    assert got[(1, 0)] == ("5 мая", 0.9) and got[(2, 0)] == ("30 дней", 1.0)


def test_boundary_checks(spark):
    none = F.lit(None).cast("string")
    check(spark, [("t", "manual", None, True), ("t", "url", None, False), ("t", "url", "http://a.b", True), ("t", "manual", "no url", False), ("", "manual", None, False), ("x" * 301, "manual", None, False)], "t string, s string, u string", contracts.valid_record(F.col("t"), none, F.col("s"), F.col("u")))
    check(spark, [("ab", "1234567890", "", "", True), ("a", "", "", "", False), ("ab", "123", "", "", False), ("ab", None, "123456789", "1234567890123", True)], "n string, inn string, k string, o string", contracts.valid_company(F.col("n"), F.col("inn"), F.col("k"), F.col("o")))
    check(spark, [(0, False), (1, True), (10, True), (11, False), (None, False)], "n int", contracts.valid_upload(F.col("n"), 10))


def test_limits_from_settings():
    assert usage.plan_limits({"BILLING_DEMO_AI_PER_MONTH": "0", "BILLING_STARTER_DRAFT_PER_MONTH": "-3"}) == {"demo": (0, 10), "starter": (500, 200)}
    assert settings.extraction_limits({"EXTRACT_ZIP_MAX_FILES": "12abc", "EXTRACT_ZIP_MAX_DEPTH": "0", "EXTRACT_OCR_ENABLED": "YES"}) == settings.ExtractionLimits(zip_max_files=12, ocr_enabled=True)
    assert settings.parse_env("A=1\n# x\n\nB='q=2'\nA=3\nno", {"C": "1"}) == {"A": "1", "B": "q=2"}


def test_reads(spark):
    rows = spark.range(5)
    with pytest.raises(ValueError):
        reads.page(rows, 0, F.col("id"))
    assert reads.page(rows, None, F.desc("id"), default=2).collect()[0].id == 4
    with pytest.raises(Exception, match="exactly one"):
        reads.exactly_one(reads.scoped(rows, id=9)).collect()
