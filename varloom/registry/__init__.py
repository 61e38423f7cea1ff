"""All checked queries."""

from __future__ import annotations

from importlib import import_module

from varloom.registry.core import ORACLES, QUERIES

MODULES = (
    "flagship",
    "predicates",
    "aggregates",
    "proximity_queries",
    "sets_joins",
    "matrices",
    "spectra",
    "io",
)


def _load() -> None:
    for name in MODULES:
        import_module(f"varloom.registry.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
