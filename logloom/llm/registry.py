"""Queries and oracle SQL of the training-data operators, gathered from their modules."""

from __future__ import annotations

import importlib

MODULES = (
    "lm_scoring",
    "toxicity",
    "quality_classifier",
    "language_id",
    "substring_dedup",
    "jaccard_join",
    "mixing",
    "decontamination",
    "quality_rules",
    "url_filters",
)


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"{__package__}.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(importlib.import_module(f"{__package__}.{name}").ORACLE_SQL)
    return out
