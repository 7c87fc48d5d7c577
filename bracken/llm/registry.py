"""Queries and SQL of this package, gathered from its q-modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q01", "q02", "q03", "q04", "q05", "q06", "q07", "q08", "q09", "q10", "q11", "q12", "q13")


def _gather(what: str) -> dict:
    from importlib.util import find_spec

    found: dict = {}
    for m in MODULES:
        if find_spec(f"{__package__}.{m}"):
            found |= getattr(import_module(f"{__package__}.{m}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
