"""Settings from the environment and from .env files."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class ExtractionLimits:
    text_max_chars: int = 500_000
    zip_max_files: int = 200
    zip_max_total_bytes: int = 100 * 1024 * 1024
    zip_max_depth: int = 4
    zip_max_nest_level: int = 3
    zip_max_entry_bytes: int = 25 * 1024 * 1024
    ocr_enabled: bool = False


#: The settings that replace the limits.
_NAMES = {
    "text_max_chars": "EXTRACT_TEXT_MAX_CHARS",
    "zip_max_files": "EXTRACT_ZIP_MAX_FILES",
    "zip_max_total_bytes": "EXTRACT_ZIP_MAX_TOTAL_BYTES",
    "zip_max_depth": "EXTRACT_ZIP_MAX_DEPTH",
    "zip_max_nest_level": "EXTRACT_ZIP_MAX_NEST_LEVEL",
    "zip_max_entry_bytes": "EXTRACT_ZIP_MAX_ENTRY_BYTES",
}


def extraction_limits(settings: Mapping[str, str] = os.environ) -> ExtractionLimits:
    """Limits with settings applied: whole numbers above 0 count, with anything after them ignored; true is 1, true or yes."""
    found = {}
    for field, name in _NAMES.items():
        number = re.match(r"\s*[+-]?\d+", settings.get(name) or "")
        if number and int(number[0]) > 0:
            found[field] = int(number[0])
    return ExtractionLimits(**found, ocr_enabled=(settings.get("EXTRACT_OCR_ENABLED") or "").lower() in ("1", "true", "yes"))


def parse_env(text: str, known: Mapping[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines; blank lines, # lines and names already known are skipped, matching quotes are taken off."""
    found: dict[str, str] = {}
    for line in text.split("\n"):
        line = line.strip()
        name, equals, value = line.partition("=")
        if not line or line.startswith("#") or not equals:
            continue
        name, value = name.strip(), value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if name not in found and name not in (known or {}):
            found[name] = value
    return found
