"""Vectors, cosine similarity and exact dense top-k.

* E5 ``hashed_vector``: a text's tokens are hashed to 64 buckets on the JVM
  (md5 of each token), and an Arrow UDF counts them per row with
  ``numpy.bincount`` over Arrow's buffers - the only Python step.
* E6/E7 are pure column expressions (``transform`` / ``zip_with`` /
  ``aggregate``), no Python.
* E8 ``dense_topk``: exact inner-product search of a query set against all
  documents, in blocks.  Both sides are packed into blocks of a fixed number
  of unit vectors; every document block meets every query block in one matrix
  multiply and sends its k best rows per query to the final per-query top-k.
  The plan is the same at every size: Spark shares the written query blocks
  with all tasks where their measured size allows and pairs partitions where
  not; nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, tokenize
from ..session import scratch_path
from .bm25 import top_k
from .sizing import by_query, spread

DIM = 64
EPS = 1e-10
# Vectors of a document block and of a query block: 4096 x 512 scores are 16 MB.
DOC_BLOCK = 4096
QUERY_BLOCK = 512
# Documents are dealt over so many tasks that each has this many at least: fewer
# would make blocks from which nearly every row is among the best.
DEAL = 512
# Vectors of a row group of written blocks.  Spark reads up to 4,096 rows of a row group at
# once, whatever their size: that many full query blocks are 1 GB, these vectors 8 MB.
GROUP = 16384
# Pairs of blocks that a task meets.  Arrow sends a task's rows to Python in one
# batch up to 10,000 rows, whatever their size: 32 pairs of full blocks are 75 MB.
PAIRS = 32


def token_buckets(tokens, dim: int = DIM) -> Column:
    """Bucket of every token: first 32 bits of its md5, modulo ``dim``."""
    return F.transform(col_(tokens),
                       lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int"))


# Rows whose buckets are counted at once.
COUNT_ROWS = 256


def _bincount_udf(dim: int):
    @F.arrow_udf("array<double>")
    def bincount(s: pa.Array) -> pa.Array:
        # Arrow's own buffers are read; a count is over the (row, bucket) cells of some rows of the batch
        ends, flat = s.offsets.to_numpy(), s.values.to_numpy()
        out = np.empty((len(s), dim))
        for lo in range(0, len(s), COUNT_ROWS):
            cut = ends[lo:lo + COUNT_ROWS + 1]
            n = len(cut) - 1
            cells = np.repeat(np.arange(n) * dim, np.diff(cut)) + flat[cut[0]:cut[-1]]
            out[lo:lo + n] = np.bincount(cells, minlength=n * dim).reshape(n, dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dim, pa.int32()), pa.array(out.ravel()))
    return bincount


def hashed_vector(text, dim: int = DIM) -> Column:
    """E5 built-in embedder: term counts hashed into ``dim`` buckets; a null text counts as empty."""
    return bucket_vector(tokenize(F.coalesce(col_(text), F.lit(""))), dim)


def bucket_vector(tokens, dim: int = DIM) -> Column:
    """The embedder over a column of tokens."""
    return _bincount_udf(dim)(token_buckets(tokens, dim))


# Texts given to an embedder at once.
EMBED_BATCH = 32


def embedded(df: DataFrame, text: str, make: Callable[[], Callable] | None = None, batch: int = EMBED_BATCH,
             out: str = "v") -> DataFrame:
    """E5: ``df`` with a vector of each text; by default the hashed one, computed without a model.

    ``make`` builds a model, a callable that turns a list of texts into as many
    vectors.  It travels to the tasks and is called once in each, before its
    first text; the model then gets lists of up to ``batch`` texts, whatever
    the size of Arrow's batches.  A null text has a null vector from a model and
    is not sent; a model that returns another number of vectors is an error.
    """
    if make is None:
        return df.withColumn(out, hashed_vector(text))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        model = None
        for b in batches:
            texts = b.column(text).to_pylist()
            at = [i for i, x in enumerate(texts) if x is not None]
            vectors: list = [None] * len(texts)
            for lo in range(0, len(at), batch):
                own = at[lo:lo + batch]
                model = model or make()
                found = np.asarray(model([texts[i] for i in own]), dtype=np.float64)
                if found.shape[:1] != (len(own),):
                    raise ValueError(f"the model gave {len(found)} vectors for {len(own)} texts")
                for i, v in zip(own, found, strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(vectors, pa.list_(pa.float64()))],
                                             names=[*names, out])

    return df.mapInArrow(run, schema)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(col_(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """V / (||v|| + 1e-10)."""
    v = col_(v).cast("array<double>")
    n = l2_norm(v)
    return F.transform(v, lambda x: x / (n + EPS))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors, both normalised with the 1e-10 guard."""
    return dot(l2_normalize(a), l2_normalize(b))


def _local_topk(s: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int) -> pd.DataFrame:
    """Top-k rows of every column of ``s`` (docs x queries), ties by doc id; O(n) per column.

    The k-th best (rounded) score of each column is found with a partition;
    every row at or above it is a candidate (so ties at the boundary are all
    kept), and one lexsort over the candidates of all columns picks the k.
    """
    n = s.shape[0]
    kk = min(k, n)
    r = np.round(s, 9)
    thr = -np.partition(-r, kk - 1, axis=0)[kk - 1]          # k-th best per column
    q_idx, d_idx = np.nonzero((r >= thr).T)                   # candidates, grouped by column
    order = np.lexsort((ids[d_idx], -r[d_idx, q_idx], q_idx))
    q_idx, d_idx = q_idx[order], d_idx[order]
    first = np.searchsorted(q_idx, q_idx, side="left")        # start of each column's run
    keep = (np.arange(len(q_idx)) - first) < kk
    pos = (np.arange(len(q_idx)) - first)[keep]
    q_idx, d_idx = q_idx[keep], d_idx[keep]
    return pd.DataFrame({"qid": qids[q_idx], "doc": ids[d_idx], "score": s[d_idx, q_idx],
                         "rank": (pos + 1).astype(np.int32)})


def vector_blocks(df: DataFrame, key: str, vec: str, rows: int) -> DataFrame:
    """(ids array, m binary): unit vectors of up to ``rows`` rows a block, written once."""
    kind = df.schema[key].dataType.simpleString()

    def pack(it):
        for pdf in it:
            for i in range(0, len(pdf), rows):
                part = pdf.iloc[i:i + rows]
                v = np.stack(part[vec].to_numpy()).astype(np.float64)
                v = v / (np.linalg.norm(v, axis=1, keepdims=True) + EPS)
                yield pd.DataFrame({"ids": [part[key].to_numpy()], "m": [v.tobytes()]})

    blocks = df.select(key, vec).where(F.col(vec).isNotNull()).mapInPandas(pack, f"ids array<{kind}>, m binary")
    path = scratch_path(df.sparkSession, "vector_blocks")
    blocks.write.option("parquet.block.row.count.limit", max(GROUP // rows, 1)).parquet(path)
    return df.sparkSession.read.schema(blocks.schema).parquet(path)


def dense_topk(docs: DataFrame, did: str, dvec: str, queries: DataFrame, qid: str, qvec: str, k: int = 5) -> DataFrame:
    """(qid, doc, score, rank) - exact top-k by cosine, ties by doc id; ids keep their types."""
    d_kind, q_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, did), (queries, qid)))
    d = vector_blocks(_dealt(docs), did, dvec, DOC_BLOCK)
    q = vector_blocks(queries, qid, qvec, QUERY_BLOCK).select(F.col("ids").alias("qids"), F.col("m").alias("qm"))
    n_d, n_q = d.count(), q.count()  # rows of written blocks
    tasks = max(-(-n_d * n_q // PAIRS), min(n_d * n_q, d.sparkSession.sparkContext.defaultParallelism), 1)
    met = d.repartition(tasks).crossJoin(q) if n_d >= n_q else q.repartition(tasks).crossJoin(d).select(
        "ids", "m", "qids", "qm")

    def score(it):
        for pdf in it:
            for ids, m, qids, qm in pdf.itertuples(index=False):
                a = np.frombuffer(m).reshape(len(ids), -1)
                b = np.frombuffer(qm).reshape(len(qids), -1)
                yield _local_topk(a @ b.T, _sortable(ids), _sortable(qids), k)

    scored = met.mapInPandas(score, f"qid {q_kind}, doc {d_kind}, score double, rank int")
    # one block of documents leaves nothing to rank before the rows are dealt
    return top_k(by_query(scored, n_q * QUERY_BLOCK) if n_d == 1 else scored, k)


def _dealt(docs: DataFrame) -> DataFrame:
    """Few documents are gathered into full blocks, others are dealt as by ``spread``."""
    some = -(-docs.count() // DEAL)
    return docs.repartition(max(some, 1)) if some < docs.sparkSession.sparkContext.defaultParallelism else spread(docs)


def _sortable(ids) -> np.ndarray:
    return np.array(list(ids))


def dense_topk_threshold(docs, did, dvec, queries, qid, qvec, k=5, threshold=0.0) -> DataFrame:
    """Top-k first, then drop hits under the threshold."""
    return dense_topk(docs, did, dvec, queries, qid, qvec, k).filter(F.col("score") >= threshold)


# ---------------------------------------------------------------- registry

def unit_embeddings(t) -> DataFrame:
    return t.embeddings.select("vec_id", "label", l2_normalize("embedding").alias("v"))


def label_centroids(t) -> DataFrame:
    """One query per label: the mean of its unit vectors (a bounded 64-wide row per label)."""
    u = unit_embeddings(t)
    per = (u.select("label", F.posexplode("v").alias("i", "x"))
           .groupBy("label", "i").agg(F.avg("x").alias("x")))
    return (per.groupBy("label")
            .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
            .select("label", F.transform("p", lambda s: s["x"]).alias("c")))


def _t(spark, sf_dir):
    from ..session import Tables
    return Tables(spark, sf_dir)


def _q_l2_normalize(spark, sf_dir):
    t = _t(spark, sf_dir)
    u = unit_embeddings(t)
    return u.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_v"),
                    F.round(F.element_at("v", 1), 6).alias("v1"),
                    F.round(l2_norm("v"), 6).alias("norm"))


def _q_cosine(spark, sf_dir):
    """E7 over a table of pairs: every vector with the centroid of its own label."""
    t = _t(spark, sf_dir)
    cents = label_centroids(t).select(F.col("label").alias("query_label"), "c")
    return (t.embeddings.join(cents, F.col("label") == F.col("query_label"))
            .select("query_label", "vec_id",
                    F.round(cosine("c", "embedding"), 6).alias("cosine")))


def _q_dense_topk(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = dense_topk(t.embeddings, "vec_id", "embedding", label_centroids(t), "label", "c", k=5)
    return r.select(F.col("qid").alias("query_label"), F.col("doc").alias("vec_id"),
                    F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _q_dense_threshold(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = dense_topk_threshold(t.embeddings, "vec_id", "embedding", label_centroids(t), "label", "c",
                             k=10, threshold=0.3)
    return r.select(F.col("qid").alias("query_label"), F.col("doc").alias("vec_id"),
                    F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _q_embed_text(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = embedded(spread(t.documents).select("doc_id", "text"), "text")
    return v.select("doc_id",
                    F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_tokens"),
                    F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("nnz"),
                    F.round(l2_norm("v"), 6).alias("norm"))


_UNIT = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10)) AS v FROM e)"""
_CENT = _UNIT + """,
ex AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u),
pc AS (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i),
c0 AS (SELECT label, list(x ORDER BY i) AS c FROM pc GROUP BY label),
cq AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-10)) AS c FROM c0),
sc AS (SELECT cq.label AS query_label, u.vec_id, list_dot_product(u.v, cq.c) AS s FROM u CROSS JOIN cq)"""

HASH_BUCKET = r"CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64"

ORACLES = {
    "l2_normalize": "WITH " + _UNIT + """
SELECT vec_id, round(list_sum(v), 6) AS sum_v, round(v[1], 6) AS v1,
       round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm FROM u""",
    "cosine_similarity": "WITH " + _CENT + "\nSELECT query_label, vec_id, round(s, 6) AS cosine FROM sc JOIN e USING (vec_id) WHERE e.label = query_label",
    "dense_topk": "WITH " + _CENT + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM sc)
SELECT query_label, vec_id, CAST(rank AS BIGINT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 5""",
    "dense_topk_threshold": "WITH " + _CENT + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM sc)
SELECT query_label, vec_id, CAST(rank AS BIGINT) AS rank, round(s, 6) AS score FROM r WHERE rank <= 10 AND s >= 0.3""",
    "embed_text": rf"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS tok FROM documents),
b AS (SELECT doc_id, {HASH_BUCKET} AS bucket, count(*) AS n FROM tk GROUP BY doc_id, bucket),
per AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS nnz, sqrt(sum(n * n)) AS norm FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(nnz, 0) AS nnz, round(coalesce(norm, 0.0), 6) AS norm
FROM documents d LEFT JOIN per USING (doc_id)""",
}

QUERIES = {
    "l2_normalize": _q_l2_normalize,
    "cosine_similarity": _q_cosine,
    "dense_topk": _q_dense_topk,
    "dense_topk_threshold": _q_dense_threshold,
    "embed_text": _q_embed_text,
}
