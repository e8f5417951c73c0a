"""A kept BM25 index in segments, and exact top-k over blocks with bounds.

``SparseIndex`` is a folder.  Each batch of documents becomes a segment: its
tokens, its terms with their document frequencies, and its postings, sorted by
impact and cut into blocks of ``BLOCK`` documents of one term; a block carries
the largest term count and the smallest document length it holds, which bound
what it can give under whatever mean length the index has later.  A segment
counts once its row of statistics is written, last of all, so a batch that
failed midway is not seen.  Statistics of an index are sums over its segments:
adding batches gives the results of one build.

``topk`` opens the index and never reads documents.  Over few documents, where
a term has no second block, all of its documents are scored.  For every query
otherwise:

1. the strongest block of its strongest terms is read; the k-th best of these
   partial scores is a lower bound of the result;
2. its terms, weakest first, are set aside as long as all of them together stay
   below the bound: no document without another term can be in the result;
3. of the other terms only those blocks are read whose bound, with the most the
   rest of the query could add, reaches the lower bound; the partial scores
   raise it;
4. documents whose partial score and the terms set aside can still reach it are
   completed, and ranked.

Scale: sorting by (term, impact) spreads a frequent term over many tasks, and
blocks are cut as sorted rows stream by; no term is gathered.  A frequent term
costs a query one row a block it cannot rule out, not one a document.  Joins
carry no hints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import path_exists, scratch_path
from .bm25 import B, FEW, K1, SLACK, _written, idf_of, postings, query_terms, top_k, topk_in_full
from .sizing import spread

BLOCK = 128     # documents of a block
SEGMENT = "segment int, docs long, length long"
SEEDS = 8       # terms of a query that give its first bound


def blocks_of(post: DataFrame, avgdl: float, size: int = BLOCK) -> DataFrame:
    """(doc, term, dl, tf) -> (term, n, max_tf, min_dl, docs, tfs, dls), strongest documents of a term first."""
    kind = post.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            term = b.column("term").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            place = np.arange(len(term)) - np.repeat(new, np.diff(np.r_[new, len(term)]))
            start = np.flatnonzero(place % size == 0)
            ends = pa.array(np.r_[start, len(term)], pa.int32())
            tf, dl = (b.column(c).to_numpy().astype(np.int64) for c in ("tf", "dl"))
            lists = [pa.ListArray.from_arrays(ends, c) for c in (b.column("doc"), pa.array(tf), pa.array(dl))]
            yield pa.RecordBatch.from_arrays(
                [b.column("term").take(pa.array(start)), pa.array(np.diff(np.r_[start, len(term)])),
                 pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(dl, start)), *lists],
                names=["term", "n", "max_tf", "min_dl", "docs", "tfs", "dls"])

    weak = -_part(F.col("tf"), F.col("dl"), avgdl)
    kinds = f"term string, n long, max_tf long, min_dl long, docs array<{kind}>, tfs array<long>, dls array<long>"
    order = ("term", weak, "doc")
    return (post.select("term", "doc", "tf", "dl").repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(run, kinds))


def _part(tf: Column, dl: Column, avgdl: float, k1: float = K1, b: float = B) -> Column:
    """A term's share of a score, before its weight: grows with tf, falls with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl if avgdl else 1.0)))


class SparseIndex:
    """A BM25 index kept in a folder that the driver and all executors share.

    An opened index shows the segments there were when it was first asked, and
    those it adds itself.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "sparse-index")
        self._rows: list | None = None
        self._tables: dict[str, DataFrame] = {}

    def _manifest(self) -> list:
        """(segment, docs, length) of the complete segments: a row a batch, read once."""
        if self._rows is None:
            there = path_exists(self.spark, f"{self.path}/segments")
            self._rows = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/segments").collect() if there else []
        return self._rows

    def _changed(self) -> None:
        self._rows, self._tables = None, {}

    def segments(self) -> list[int]:
        """Numbers of the complete segments; there is one for each batch added."""
        return sorted(r["segment"] for r in self._manifest())

    def table(self, name: str) -> DataFrame:
        """tokens (doc, toks), terms (term, df, ctf) or blocks of all segments, with ``segment``."""
        if name not in self._tables:
            paths = [f"{self.path}/{name}/segment={n}" for n in self.segments()]
            if not paths:
                raise ValueError(f"no documents in the index at {self.path}")
            self._tables[name] = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
        return self._tables[name]

    def add(self, docs: DataFrame, did: str, text: str) -> SparseIndex:
        """Add a batch of documents as a segment; the segments before it are neither read nor changed."""
        self._changed()
        n = max(self.segments(), default=-1) + 1
        to = {name: f"{self.path}/{name}/segment={n}" for name in ("tokens", "terms", "blocks")}
        spread(docs).select(F.col(did).alias("doc"), tokenize(text).alias("toks")).write.mode("overwrite").parquet(to["tokens"])
        tokens = self.spark.read.parquet(to["tokens"])
        docs_, length = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("toks")), F.lit(0))).head()
        blocks_of(postings(tokens, length), length / docs_ if docs_ else 1.0).withColumn(
            "block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(to["blocks"])
        count = F.aggregate("tfs", F.lit(0).cast("long"), lambda x, y: x + y)
        self.spark.read.parquet(to["blocks"]).groupBy("term").agg(
            F.sum("n").alias("df"), F.sum(count).alias("ctf")).write.mode("overwrite").parquet(to["terms"])
        self.spark.createDataFrame([(n, docs_, length)], SEGMENT).coalesce(1).write.mode("append").parquet(
            f"{self.path}/segments")
        self._changed()
        return self

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        n, length = (sum(r[c] for r in self._manifest()) for c in ("docs", "length"))
        return n, length / n if n else 0.0

    def terms(self) -> DataFrame:
        """(term, df, ctf) over all segments."""
        return self.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))

    def topk(self, queries: DataFrame, qid: str, qtext: str, k: int, k1: float = K1, b: float = B,
             seeds: int = SEEDS) -> DataFrame:
        """(qid, doc, score, rank), exact."""
        n_docs, avgdl = self.stats()
        asked = query_terms(queries, qid, qtext)
        if not n_docs:
            kind = self.table("tokens").schema["doc"].dataType.simpleString() if self.segments() else "long"
            return asked.limit(0).select("qid", F.lit(None).cast(kind).alias("doc"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        if n_docs <= min(BLOCK, FEW):
            df_ = self.terms().select("term", idf_of(F.col("df"), n_docs).alias("idf"))
            gives = self._postings(self.table("blocks"), avgdl, k1, b).join(df_, "term").select(
                "term", "doc", (F.col("idf") * F.col("p")).alias("p"))
            return topk_in_full(queries, qid, qtext, _written(gives, "sparse-gives"), k)
        wanted = asked.select("term").distinct()
        all_blocks = self.table("blocks").join(wanted, "term", "left_semi")
        head = _written(all_blocks.select("term", "segment", "block", "n",
                                          _part(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b).alias("top")), "sparse-heads")
        idf = idf_of(F.col("df"), n_docs)
        best = head.groupBy("term").agg(F.max("top").alias("top"), F.max_by(F.struct("segment", "block"), "top").alias("at"))
        weights = _written(asked.join(self.terms().join(wanted, "term", "left_semi"), "term").join(best, "term").select(
            "qid", "term", (F.col("qtf") * idf).alias("w"), (F.col("qtf") * idf * F.col("top")).alias("most"),
            "at.segment", "at.block"), "sparse-weights")
        # 1. the strongest block of the strongest terms
        strongest = Window.partitionBy("qid").orderBy(F.col("most").desc(), "term")
        first = weights.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= seeds)
        bound = _kth(self._partial(first, avgdl, k1, b), k)
        # 2. terms that cannot reach the bound without another one
        weakest = Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        plan = weights.select("qid", "term", "w", "most").join(bound, "qid", "left").withColumn(
            "low", F.coalesce("low", F.lit(0.0)) - SLACK)
        plan = plan.withColumn("upto", F.sum("most").over(weakest)).withColumn("needed", F.col("upto") >= F.col("low"))
        all_ = Window.partitionBy("qid")
        plan = _written(plan.withColumn("all", F.sum("most").over(all_)).withColumn(
            "aside", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("most"))).over(all_), F.lit(0.0))), "sparse-plan")
        # 3. blocks that can hold a document of the result
        reads = plan.where("needed").join(head.select("term", "segment", "block", "top"), "term").where(
            F.col("w") * F.col("top") + F.col("all") - F.col("most") >= F.col("low"))
        part = _written(self._partial(reads.select("qid", "w", "segment", "block"), avgdl, k1, b), "sparse-partial")
        raised = plan.select("qid", "aside", "low").distinct().join(
            _kth(part, k).withColumnRenamed("low", "better"), "qid", "left")
        stay = part.join(raised, "qid").where(
            F.col("score") + F.col("aside") >= F.greatest("low", F.coalesce("better", F.lit(0.0)) - SLACK)).select("qid", "doc", "score")
        # 4. the terms set aside, for the documents left
        aside = plan.where(~F.col("needed")).select("qid", "term", "w")
        rest = self._postings(all_blocks.join(aside.select("term").distinct(), "term", "left_semi"), avgdl, k1, b)
        more = stay.select("qid", "doc").join(aside, "qid").join(rest.select("term", "doc", "p"), ["term", "doc"]).groupBy(
            "qid", "doc").agg(F.sum(F.col("w") * F.col("p")).alias("more"))
        done = stay.join(more, ["qid", "doc"], "left").select(
            "qid", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        return top_k(done, k)

    def _postings(self, blocks: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
        """Blocks -> their postings with ``p``, the part of a score."""
        keep = [c for c in blocks.columns if c not in ("n", "max_tf", "min_dl", "docs", "tfs", "dls")]
        one = blocks.select(*keep, F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("x"))
        return one.select(*keep, F.col("x.docs").alias("doc"), _part(F.col("x.tfs"), F.col("x.dls"), avgdl, k1, b).alias("p"))

    def _partial(self, reads: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
        """(qid, w, segment, block) -> (qid, doc, score): what these blocks give."""
        blocks = self.table("blocks").select("segment", "block", "docs", "tfs", "dls")
        hit = self._postings(reads.select("qid", "w", "segment", "block").join(blocks, ["segment", "block"]), avgdl, k1, b)
        return hit.groupBy("qid", "doc").agg(F.sum(F.col("w") * F.col("p")).alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(qid, low): each query's k-th best score, if it has k."""
    return top_k(scored, k).groupBy("qid").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("m")).where(
        F.col("m") == k).select("qid", "low")
