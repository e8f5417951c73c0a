"""Parallelism for inputs that arrive in few splits.

Joins carry no broadcast hints: Spark decides from measured sizes (file
statistics, and map output at run time), so no row count is taken for a size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


# Queries of a task: their hits take far more room than the shuffled bytes by which Spark joins partitions.
PER_TASK = 20000


def by_query(df: DataFrame, n_queries: int, key: str = "qid") -> DataFrame:
    """Deal rows by query, over tasks that grow with the number of queries."""
    return df.repartition(max(-(-n_queries // PER_TASK), df.sparkSession.sparkContext.defaultParallelism), key)


def spread(df: DataFrame) -> DataFrame:
    """Deal CPU-heavy text work over all cores when the input is a few files.

    Looks at the input's file list only, nothing runs.  A corpus of many files
    is left where it is and no shuffle is added.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if len(df.inputFiles()) < want else df
