"""Collects the ``QUERIES`` / ``ORACLES`` dicts of every module."""

from __future__ import annotations

import importlib

MODULES = (
    "quarry.operators.bm25",
    "quarry.plans.relational",
    "quarry.plans.textq",
    "quarry.operators.compare",
    "quarry.operators.dense",
    "quarry.operators.hybrid",
    "quarry.operators.retrieval_eval",
    "quarry.plans.reports",
    "quarry.plans.evaluation",
    "quarry.sources.catalog",
    "quarry.operators.schema_docs",
    "quarry.sources.roundtrip",
    "quarry.streaming.rollup",
)


def _merge(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        mod = importlib.import_module(m)
        d = getattr(mod, attr, {})
        dup = set(out) & set(d)
        if dup:
            raise ValueError(f"duplicate keys {sorted(dup)} in {m}")
        out.update(d)
    return out


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLES")
