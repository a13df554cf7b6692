"""Thresholds of the engine; every function takes them as a parameter, and the clock with them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Settings:
    extraction_confidence_warn: float = 0.60
    field_review_threshold: float = 0.5
    ocr_confidence_warn: float = 0.80
    ocr_fallback_confidence: float = 0.40
    money_abs_tolerance: float = 0.01
    money_pct_tolerance: float = 0.0
    date_tolerance_days: int = 3
    string_fuzzy_threshold: float = 0.85
    section_min_chars: int = 500
    max_sections: int = 40
    few_shot_examples: int = 5
    invoice_max_total: float = 10_000.0
    contract_max_value: float = 100_000.0
    mapping_threshold: float = 0.3
    sheet_max_rows: int = 500
    sheet_max_cols: int = 60
    min_dpi: float = 100.0
    blur: float = 60.0
    contrast: float = 30.0
    dark: float = 50.0
    blank_ink: float = 0.01
    max_skew_degrees: float = 2.0
    as_of: date = date(2024, 1, 31)


DEFAULT = Settings()
