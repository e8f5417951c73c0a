"""Collects the ``QUERIES`` and ``ORACLES`` of the operator modules."""

from __future__ import annotations

import importlib

MODULES = (
    "decontaminate", "secrets", "mixing", "toxicity", "quality",
    "linededup", "licenses", "jaccard", "ctwlm", "neardup_vectors", "ann", "conversations",
    "collocations",
)


def _merge(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"quarry.llm.{m}"), attr, {}))
    return out


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLES")
