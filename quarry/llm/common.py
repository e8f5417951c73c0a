"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

# Rows in one Arrow batch sent to a Python worker: texts may be very long, so
# the batch is kept small to bound a worker's memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int | None = None) -> None:
    """Bound the rows and, if asked, the bytes of an Arrow batch in this session; a longer row is a batch of its own."""
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


_collecting: list[list[str]] = []


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Notes in ``paths`` the tables that ``materialize`` writes meanwhile."""
    _collecting.append(paths)
    try:
        yield
    finally:
        _collecting.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete these written tables and empty the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        p = jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(conf).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage with a table every executor can read, so a lost executor
    costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _collecting:
        _collecting[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id's text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"__{stem}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
