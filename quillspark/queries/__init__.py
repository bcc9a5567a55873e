"""Registered queries of the retrieval operators, with SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ("text", "plan", "corpus", "layout", "retrieval", "evidence", "selection", "relevance", "diagnosis", "metrics", "release", "hybrid")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
