"""Queries of this package and, where SQL can express them, their equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "fingerprint",
    "grid_join",
    "page_text",
    "pieces",
    "mixing",
    "pii",
    "langid",
    "quality",
    "ngram_join",
    "substring_dedup",
    "manifest",
    "windows",
    "lexical",
)


def queries() -> dict:
    """Every ``q_`` function of the operator modules under its plain name."""
    found = {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        found |= {k[2:]: f for k, f in vars(module).items() if k.startswith("q_")}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), "ORACLES", {})
    return found
