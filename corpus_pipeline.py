"""The corpus pipeline: five stages over ``documents``, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; its result is written as Parquet and read again for the
next.  All but the last return the columns of ``documents``.  The last returns
the mix: every document taken, with its text and the words it contributes.

ORACLE_SQL is None: trees, calibration and similarity components are not
expressible in SQL; tests/llm/test_pipeline.py checks the stages against
brute-force versions.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, linededup, mixing, toxicity
from quarry.llm.common import collecting, drop_tables, materialize, table

ORACLE_SQL = None

# Working tables of the stage called last.
_working: list[str] = []


def stage(f):
    """A stage first deletes the working tables of the stage before.

    That stage's result has been written by then, as this one's ``docs`` are
    read from it.
    """
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _working)
        with collecting(_working):
            return f(spark, docs, sf_dir)
    return call


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored toxic go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@stage
def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines frequent within their source go; every document stays."""
    return linededup.clean(docs)


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold benchmark windows go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents of the mix with their text, size, source_size, target and taken words.

    The text is that of the stage before, once a row; ``taken`` may count its
    words up to three times.
    """
    rest = tuple(c for c in ("text", "lang", "n_chars") if c in docs.columns)
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"), keep=rest).drop("key").where(
        F.col("taken") > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = materialize(f(spark, docs, sf_dir), f"stage-{name}")
    drop_tables(spark, _working)
    return docs
