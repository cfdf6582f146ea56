"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from factfade.plans.registry import ORACLES, QUERIES, Query

_SECTIONS = ("core", "recall", "cleaning", "similar", "writing", "log", "marked")


def _load() -> None:
    for section in _SECTIONS:
        import_module(f"factfade.plans.{section}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
