"""Tiny registration helper: a query function next to its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, key: str, oracle: str | None = None):
        """Register ``fn(t: Tables) -> DataFrame`` under ``key``."""
        def deco(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Tables(spark, sf_dir))
            run.__name__ = f"q_{key}"
            run.__doc__ = fn.__doc__
            if key in self.queries:
                raise ValueError(f"duplicate key {key}")
            self.queries[key] = run
            if oracle is not None:
                self.oracles[key] = oracle
            return fn
        return deco
