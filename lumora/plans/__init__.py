"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("hands", "vision", "metrics", "audits", "checks", "streams", "records", "camera", "annotations", "files")


def _all() -> dict:
    out = {}
    for m in _MODULES:
        out |= import_module(f"lumora.plans.{m}").QUERIES
    return out


def queries() -> dict:
    """Every query by name; each takes (spark, sf_dir)."""
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
