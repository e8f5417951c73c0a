"""A vector store kept in a folder, in appended segments.

``add`` writes its batch only; the segments before it are neither read nor
rewritten.  A segment counts once its row in the manifest is written, last of
all, so a batch that failed midway is not seen and its number is used again.
Positions go on from the manifest's total, lookups give the last document added
under an id, and ``merge`` rewrites the latest of every id as one segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, scratch_path
from .files import STORE_SCHEMA, store_add, store_get

_MANIFEST = "segment int, docs long, upto long, first int"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "vector-store")

    def manifest(self) -> DataFrame | None:
        """One row a segment: its documents, the positions used up to its end, the first segment still valid."""
        path = f"{self.path}/manifest"
        return self.spark.read.schema(_MANIFEST).parquet(path) if path_exists(self.spark, path) else None

    def _state(self) -> tuple[list[int], int, int]:
        """(valid segments, next position, next segment)."""
        m = self.manifest()
        if m is None:
            return [], 0, 0
        rows = m.collect()  # a row a batch
        first = max(r["first"] for r in rows)
        return (sorted(r["segment"] for r in rows if r["segment"] >= first), max(r["upto"] for r in rows),
                max(r["segment"] for r in rows) + 1)

    def load(self) -> DataFrame | None:
        """All documents of the valid segments, or None when nothing was saved here."""
        segments, _, _ = self._state()
        if not segments:
            return None
        paths = [f"{self.path}/vectors/segment={n}" for n in segments]
        return self.spark.read.schema(STORE_SCHEMA + ", segment int").option("basePath", f"{self.path}/vectors").parquet(
            *paths).drop("segment")

    def _write(self, docs: DataFrame, segment: int, upto, first: int) -> None:
        path = f"{self.path}/vectors/segment={segment}"
        docs.write.mode("overwrite").partitionBy("db_name").parquet(path)
        n, last = self.spark.read.schema(STORE_SCHEMA).parquet(path).agg(F.count(F.lit(1)), F.max("seq")).head()
        upto = max(upto, 0 if last is None else last + 1)
        self.spark.createDataFrame([(segment, n, upto, first)], _MANIFEST).coalesce(1).write.mode("append").parquet(
            f"{self.path}/manifest")

    def add(self, batch: DataFrame, id_col: str | None, content: str, db_name: str, vec: str, order: str) -> VectorStore:
        """Append a batch with unit vectors; a missing id becomes ``doc_<position>``."""
        _, upto, segment = self._state()
        m = self.manifest()
        first = 0 if m is None else m.agg(F.max("first")).head()[0]
        self._write(store_add(None, batch, id_col, content, db_name, vec, order, base=upto), segment, upto, first)
        return self

    def get(self, ids: DataFrame | None = None) -> DataFrame:
        """One document per id (of ``ids``), the last added wins."""
        docs = self.load()
        if docs is None:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return store_get(docs if ids is None else docs.join(ids, "id", "left_semi"))

    def __len__(self) -> int:
        """Documents added and kept, those replaced under their id included; read off the manifest."""
        segments, _, _ = self._state()
        return 0 if not segments else self.manifest().where(F.col("segment").isin(segments)).agg(F.sum("docs")).head()[0]

    def merge(self) -> VectorStore:
        """One segment with the latest document of every id; older segments stay on disk, unread."""
        docs = self.load()
        if docs is not None:
            _, upto, segment = self._state()
            self._write(store_get(docs).select("id", "seq", "content", "db_name", "vector"), segment, upto, segment)
        return self

    def clear(self) -> VectorStore:
        """An empty store; positions start again."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return self
