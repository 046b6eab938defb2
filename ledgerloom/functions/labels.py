"""Display labels of codes and of error codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import trim

#: Display labels by code.
SOURCE = {"manual": "Вручную", "url": "По ссылке", "file_upload": "Файлы"}
RECORD_STATUS = {"draft": "Черновик", "active": "Активна", "archived": "Архив"}
FILE_STATUS = {"pending_upload": "Загрузка…", "stored": "В хранилище", "registration_done": "Зарегистрирован", "failed": "Ошибка"}
EXTRACTION_STATUS = {
    "none": "—",
    "pending": "В очереди",
    "processing": "Извлечение…",
    "done": "Текст извлечён",
    "failed": "Ошибка извлечения",
    "skipped_unsupported": "Пропуск",
    "quarantined": "Карантин",
}
DOCUMENT_TYPE = {
    "charter": "Устав",
    "extract_egrul": "Выписка ЕГРЮЛ",
    "power_of_attorney": "Доверенность",
    "license": "Лицензия",
    "certificate": "Сертификат",
    "other": "Другое",
}
DOCUMENT_STATUS = {"draft": "Черновик", "active": "Активен", "expired": "Истёк", "archived": "Архив"}
AUDIT_ACTION = {
    "tender.ai_analyze": "AI-разбор закупки",
    "tender.draft_generate": "Генерация черновика закупки",
    "admin.reextract_tender_file": "Повторное извлечение файла (админ)",
}
AUDIT_TARGET = {"Tender": "Закупка"}
PLAN = {"demo": "Демо", "starter": "Старт"}
CHECKLIST_STATUS = {"ok": "выполнено", "missing": "не выполнено"}
ERRORS = {
    "login_failed": "Не удалось войти.",
    "invalid_credentials": "Неверная эл. почта или пароль.",
    "register_failed": "Не удалось зарегистрироваться.",
    "email_taken": "Этот адрес почты уже занят.",
    "bad_request": "Некорректный запрос.",
    "unauthorized": "Требуется вход.",
    "not_found": "Не найдено.",
    "no_company": "Сначала создайте компанию в разделе «Документы».",
    "file_too_large": "Файл слишком большой.",
    "storage_failed": "Не удалось сохранить файл.",
    "queue_failed": "Не удалось поставить задачу в очередь.",
    "billing_limit": "Достигнут лимит тарифа.",
    "no_extracted_text": "Нет извлечённого текста. Дождитесь обработки файлов.",
    "ai_parse_failed": "Не удалось разобрать ответ AI.",
    "ai_gateway_failed": "Ошибка AI-шлюза.",
    "draft_failed": "Не удалось сгенерировать черновик.",
    "unknown_error": "Неизвестная ошибка.",
    "load_failed": "Не удалось загрузить данные.",
    "request_failed": "Запрос не выполнен.",
    "reset_failed": "Не удалось сменить пароль.",
    "invalid_token": "Ссылка для сброса недействительна или устарела.",
    "missing_token": "В ссылке нет токена.",
    "unsupported_format": "Неподдерживаемый формат.",
    "bad_file_status": "Неподходящий статус файла для этой операции.",
    "analyze_failed": "Не удалось выполнить разбор.",
    "checklist_failed": "Не удалось обновить чек-лист.",
    "pick_document": "Выберите документ.",
    "pick_file": "Выберите файл.",
}
HTTP_ERRORS = {
    "400": "Некорректный запрос.",
    "401": "Требуется вход.",
    "403": "Доступ запрещён.",
    "404": "Не найдено.",
    "409": "Конфликт данных.",
    "413": "Слишком большой объём данных.",
    "502": "Сервис временно недоступен.",
}


def label(code: Column, labels: dict[str, str], fall_back: bool = False) -> Column:
    """The code's label; an unknown code is null, or itself with fall_back."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    found = F.try_element_at(table, code)
    return F.coalesce(found, code) if fall_back else found


def audit_target(code: Column) -> Column:
    return F.coalesce(label(code, AUDIT_TARGET, fall_back=True), F.lit("—"))


def user_error(message: Column) -> Column:
    """What a user is told: known codes, HTTP codes, else the trimmed message; '' for none."""
    code = trim(message)
    http = F.regexp_extract(code, r"\Ahttp_([0-9]+)\z", 1)
    by_http = F.coalesce(label(http, HTTP_ERRORS), F.concat(F.lit("Ошибка ("), http, F.lit(").")))
    told = F.coalesce(label(code, ERRORS), F.when(http != "", by_http), code)
    return F.when(message.isNull() | (message == ""), "").otherwise(told)
