"""Text of stored files: format by native rules, then one reader per format inside mapInPandas.

An outcome has a kind (ok, skipped, quarantined, error), a text for ok, and a reason for the others. Archives are opened under
limits; sizes are the archive's own, and what is really read is bounded by them too. Readers for PDF and old spreadsheets are used
where their libraries are installed; where not, such a file is an error that says so. Old Word files and OCR have no reader.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import TRUNCATION_MARK, detect_format
from ledgerloom.sources.settings import ExtractionLimits

OUTCOME = "kind string, text string, reason string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_INNER = {"pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "spreadsheet", "xls": "spreadsheet", "zip": "zip"} | dict.fromkeys(
    ("jpg", "jpeg", "png", "webp", "gif"), "image"
)

Outcome = tuple[str, str | None, str | None]


def _text_or_empty(text: str, empty: str) -> Outcome:
    text = text.strip()
    return ("ok", text, None) if text else ("skipped", None, empty)


def read_pdf(data: bytes, limits: ExtractionLimits) -> Outcome:
    try:
        import pypdf
    except ImportError:
        return "error", None, "pdf_parse: no PDF reader is installed"
    try:
        pages = pypdf.PdfReader(io.BytesIO(data)).pages
        return _text_or_empty("\n\n".join(p.extract_text() or "" for p in pages), "pdf_empty")
    except Exception as e:  # any damage in a file is that file's outcome
        return "error", None, f"pdf_parse: {e}"


def _own(paragraph: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The elements inside a paragraph, without those of paragraphs in its text boxes."""
    for child in paragraph:
        if child.tag != f"{_WORD}p":
            yield child
            yield from _own(child)


def read_docx(data: bytes, limits: ExtractionLimits) -> Outcome:
    """Paragraphs, each followed by a blank line."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ElementTree.fromstring(_bounded(archive, archive.getinfo("word/document.xml"), limits.zip_max_total_bytes))
        marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
        paragraphs = ["".join(marks.get(n.tag, n.text or "") for n in _own(p) if n.tag == f"{_WORD}t" or n.tag in marks) for p in body.iter(f"{_WORD}p")]
        return _text_or_empty("\n\n".join(paragraphs), "docx_empty")
    except Exception as e:
        return "error", None, f"docx: {e}"


def read_doc(data: bytes, limits: ExtractionLimits) -> Outcome:
    return "error", None, "doc: no reader for old Word files is installed"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _csv(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


def _sheet_rows(sheet: ElementTree.Element, strings: list[str], dates: list[bool]) -> list[str]:
    lines: list[list[str]] = []
    for row in sheet.iter(f"{_SHEET}row"):
        number = int(row.get("r") or len(lines) + 1)
        lines += [[] for _ in range(number - 1 - len(lines))]
        cells: list[str] = []
        for cell in row.iter(f"{_SHEET}c"):
            at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            kind, value = cell.get("t"), cell.findtext(f"{_SHEET}v") or ""
            if kind == "s" and value:
                value = strings[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif value and kind in (None, "n") and dates[int(cell.get("s") or 0)]:
                day = datetime(1899, 12, 30) + timedelta(days=float(value))
                value = f"{day.month}/{day.day}/{day.year % 100:02d}"
            cells.append(_csv(value))
        lines.append(cells)
    width = max(map(len, lines), default=0)
    return [",".join(cells + [""] * (width - len(cells))) for cells in lines]


def read_spreadsheet(data: bytes, limits: ExtractionLimits) -> Outcome:
    """Each sheet that has anything, in workbook order: its name and its rows as CSV."""
    if data[:4] == b"\xd0\xcf\x11\xe0":
        try:
            frames = pd.read_excel(io.BytesIO(data), sheet_name=None, header=None, dtype=str, engine="xlrd")
        except Exception as e:
            return "error", None, f"spreadsheet: {e}"
        sheets = [(name, f.fillna("").to_csv(index=False, header=False)) for name, f in frames.items()]
        return _text_or_empty("\n\n".join(f"## {n}\n{c}" for n, c in sheets if c.strip()), "spreadsheet_empty")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
            load = lambda name: ElementTree.fromstring(_bounded(archive, archive.getinfo(name), limits.zip_max_total_bytes))
            targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}
            strings = []
            if "xl/sharedStrings.xml" in names:
                strings = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in load("xl/sharedStrings.xml").iter(f"{_SHEET}si")]
            dates = [False]
            if "xl/styles.xml" in names:
                styles = load("xl/styles.xml")
                own = {f.get("numFmtId"): (f.get("formatCode") or "").lower() for f in styles.iter(f"{_SHEET}numFmt")}
                codes = [style.get("numFmtId") or "0" for style in styles.findall(f"{_SHEET}cellXfs/{_SHEET}xf")]
                dates = [14 <= int(code) <= 22 or any(c in own.get(code, "") for c in ("yy", "dd")) for code in codes] or dates
            parts = []
            for sheet in load("xl/workbook.xml").iter(f"{_SHEET}sheet"):
                target = targets[sheet.get(_REL)].lstrip("/")
                csv = "\n".join(_sheet_rows(load(target if target.startswith("xl/") else f"xl/{target}"), strings, dates))
                if csv.strip(",\n "):
                    parts.append(f"## {sheet.get('name')}\n{csv}")
        return _text_or_empty("\n\n".join(parts), "spreadsheet_empty")
    except Exception as e:
        return "error", None, f"spreadsheet: {e}"


def read_image(data: bytes, limits: ExtractionLimits) -> Outcome:
    if not limits.ocr_enabled:
        return "skipped", None, "image_ocr_disabled"
    return "error", None, "image_ocr: no OCR engine is installed"


def read_unknown(data: bytes, limits: ExtractionLimits) -> Outcome:
    return "skipped", None, "unsupported_format"


def _bounded(archive: zipfile.ZipFile, entry: zipfile.ZipInfo, limit: int) -> bytes:
    """An entry's bytes; one that turns out larger than it says, or than the limit, is an error."""
    most = min(entry.file_size, limit)
    with archive.open(entry) as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError("entry is larger than declared")
    return data


def depth(path: str) -> int:
    return max(0, len([p for p in path.replace("\\", "/").split("/") if p]) - 1)


def read_zip(data: bytes, limits: ExtractionLimits, level: int = 0) -> Outcome:
    """The texts of an archive's files under limits: nesting, number, sizes, then depth, entry by entry."""
    if level > limits.zip_max_nest_level:
        return "quarantined", None, f"zip_nesting_too_deep:{level}>{limits.zip_max_nest_level}"
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:
        return "error", None, f"zip_load: {e}"
    with archive:
        entries = {e.filename: e for e in archive.infolist() if not e.is_dir()}  # a repeated name: the last content, at the first place
        if len(entries) > limits.zip_max_files:
            return "quarantined", None, f"zip_too_many_files:{len(entries)}>{limits.zip_max_files}"
        for name, e in entries.items():
            if e.file_size > limits.zip_max_entry_bytes:
                return "quarantined", None, f"zip_entry_too_large:{name}:{e.file_size}>{limits.zip_max_entry_bytes}"
        total = sum(e.file_size for e in entries.values())
        if total > limits.zip_max_total_bytes:
            return "quarantined", None, f"zip_total_uncompressed:{total}>{limits.zip_max_total_bytes}"
        blocks = []
        for name, e in entries.items():
            if depth(name) > limits.zip_max_depth:
                return "quarantined", None, f"zip_path_too_deep:{name}"
            try:
                inner = _bounded(archive, e, limits.zip_max_entry_bytes)
            except Exception as problem:
                return "error", None, f"zip_read:{name}:{problem}"
            base = name.rpartition("/")[2]
            kind = _INNER.get(base.rpartition(".")[2].lower() if "." in base else "", "unknown")
            if kind == "zip":
                outcome, text, reason = read_zip(inner, limits, level + 1)
                if outcome in ("quarantined", "error"):
                    return outcome, None, f"{'nested' if outcome == 'quarantined' else 'nested_zip'}:{name}:{reason}"
                blocks.append(f"--- {name} (nested zip) ---\n{text}" if outcome == "ok" else f"--- {name} ---\n[skipped:{reason}]")
            else:
                outcome, text, reason = READERS[kind](inner, limits)
                blocks.append(f"--- {name} ---\n" + (text if outcome == "ok" else f"[{outcome}:{reason}]"))
    return _text_or_empty("\n\n".join(blocks), "zip_no_text")


READERS = {
    "pdf": read_pdf,
    "docx": read_docx,
    "doc": read_doc,
    "spreadsheet": read_spreadsheet,
    "image": read_image,
    "zip": read_zip,
    "unknown": read_unknown,
}


def read_file(kind: str, data: bytes | None, limits: ExtractionLimits) -> Outcome:
    outcome, text, reason = READERS[kind](data or b"", limits)
    if text is not None and len(text) > limits.text_max_chars:
        text = text[: limits.text_max_chars] + TRUNCATION_MARK
    return outcome, text, reason


def extract(files: DataFrame, limits: ExtractionLimits | None = None) -> DataFrame:
    """files (file_id, original_name, content_type, content) → (file_id, format, kind, text, reason), one row a file."""
    set_limits = limits or ExtractionLimits()
    rows = files.select("file_id", detect_format(F.col("original_name"), F.col("content_type")).alias("format"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_file(f, c, set_limits) for f, c in zip(batch["format"], batch["content"], strict=True)]
            done = pd.DataFrame(found, columns=["kind", "text", "reason"], dtype=object)
            yield pd.concat([batch[["file_id", "format"]].reset_index(drop=True), done], axis=1)

    return rows.mapInPandas(run, f"file_id string, format string, {OUTCOME}")


def outcome_status(kind: Column) -> Column:
    """The extraction status that an outcome leads to."""
    status = {"ok": "done", "skipped": "skipped_unsupported", "quarantined": "quarantined", "error": "failed"}
    return F.coalesce(*[F.when(kind == k, v) for k, v in status.items()])


def outcome_columns(kind: Column, text: Column, reason: Column, at: Column) -> dict[str, Column]:
    """What an outcome writes: text only for ok, a reason for all others, and the time for every one."""
    ok = kind == "ok"
    return {
        "extraction_status": outcome_status(kind),
        "extracted_text": F.when(ok, text),
        "extraction_error": F.when(~ok, reason),
        "extracted_at": at,
    }
