"""Registered queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("extracts", "cleaning", "lookups", "grouping", "episodes", "rules", "tables", "weighting", "models",
            "survival", "checks", "cohorts")


def load() -> tuple[dict, dict]:
    from wardline.catalog.registry import ORACLES, QUERIES
    for section in SECTIONS:
        import_module(f"wardline.catalog.{section}")
    return QUERIES, ORACLES
