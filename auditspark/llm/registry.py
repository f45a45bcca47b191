"""Modules of this subpackage that register queries."""

from __future__ import annotations

import importlib
from types import ModuleType

NAMES = ["quality_rules", "decontaminate", "mixing", "compression_classifier", "license_scan", "token_ids", "line_dedup", "near_dedup", "katz", "substring_dedup", "vector_codes", "token_alignment", "ngram_join"]


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"auditspark.llm.{name}") for name in NAMES]
