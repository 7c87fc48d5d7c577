"""All queries over the operators, and their SQL."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

MODULES = ("text_queries", "retrieval_queries", "graph_queries", "usage_queries", "state_queries", "eval_queries", "stream_queries", "misc_queries", "more_queries", "vector_queries", "pattern_queries", "card_queries", "once_queries", "code_queries", "profile_queries", "folder_queries")


def _gather(what: str) -> dict:
    found: dict = {}
    for m in MODULES:
        if find_spec(f"{__package__}.{m}"):
            found |= getattr(import_module(f"{__package__}.{m}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
