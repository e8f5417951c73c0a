"""Min-max normalisation and hybrid (dense + sparse) fusion.

Each side is ranked to 2k per query, min-max normalised inside its own
list (window min/max over at most 2k rows per query), the two lists are
matched on (query, document), fused 0.6 dense + 0.4 sparse with
missing scores as 0, and ranked again.  Every per-query list is bounded by
2k, so no step grows with the corpus except the two top-k scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import bm25_scores, tokens_of, top_k
from .dense import bucket_vector, dense_topk, embedded, hashed_vector
from .sizing import by_query
from .sparse_index import SparseIndex

# Fusion weights.
DENSE_WEIGHT = 0.6
SPARSE_WEIGHT = 0.4


def minmax_normalize(hits: DataFrame, part: str | list[str] = "qid", score: str = "score", out: str = "norm") -> DataFrame:
    """(v - min) / (max - min) per list; 1.0 when all scores are equal."""
    w = Window.partitionBy(part)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def sparse_side(index: SparseIndex, queries, qid, qtext, k2):
    return index.topk(queries, qid, qtext, k2)


def dense_side(tokens, queries, qid, qtext, k2):
    dv = tokens.select("doc", bucket_vector("toks").alias("v"))
    qv = queries.select(F.col(qid).alias("qid"), hashed_vector(qtext).alias("qv"))
    return dense_topk(dv, "doc", "v", qv, "qid", "qv", k2)


def fuse(sparse2k: DataFrame, dense2k: DataFrame, k: int, n_queries: int) -> DataFrame:
    """E11 from the two ranked 2k lists: normalise each, match, weight, rank.

    The sparse list has a document once.  Both lists are dealt by query once and
    matched by windows over its documents: a full outer join would deal each
    list by (query, document) and the result by query again.
    """
    both = by_query(dense2k.select("qid", "doc", "score", F.lit(True).alias("dense")).unionByName(
        sparse2k.select("qid", "doc", "score", F.lit(False).alias("dense"))), n_queries)
    w = Window.partitionBy("qid", "doc")
    same = F.col("qid").isNotNull() & F.col("doc").isNotNull()  # nulls match nothing
    norm = minmax_normalize(both, ["qid", "dense"]).withColumns({
        "of_sparse": F.max(F.when(~F.col("dense") & same, F.col("norm"))).over(w),
        "in_dense": F.coalesce(F.max(F.col("dense") & same).over(w), F.lit(False))})
    zero = F.lit(0.0)
    j = norm.where(F.col("dense") | ~F.col("in_dense")).select(
        "qid", "doc", F.when(F.col("dense"), F.col("norm")).otherwise(zero).alias("dense_score"),
        F.coalesce(F.when(F.col("dense"), F.col("of_sparse")).otherwise(F.col("norm")), zero).alias("sparse_score"))
    fused = j.withColumn("score", F.col("dense_score") * DENSE_WEIGHT + F.col("sparse_score") * SPARSE_WEIGHT)
    return top_k(fused, k)


def hybrid_topk(docs: DataFrame, did: str, dtext: str, queries: DataFrame, qid: str, qtext: str,
                k: int = 5, embedder: Callable[[], Callable] | None = None) -> DataFrame:
    """(qid, doc, score, dense_score, sparse_score, rank); ``embedder`` as in ``embedded``."""
    index = SparseIndex(docs.sparkSession).add(docs, did, dtext)
    if embedder is None:
        return hybrid_search(index, queries, qid, qtext, k)
    dv = embedded(docs.select(F.col(did).alias("doc"), F.col(dtext).alias("text")), "text", embedder)
    qv = embedded(queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("text")), "text", embedder)
    dense = dense_topk(dv.select("doc", "v"), "doc", "v", qv.select("qid", F.col("v").alias("qv")), "qid", "qv", 2 * k)
    return fuse(sparse_side(index, queries, qid, qtext, 2 * k), dense, k, queries.count())


def hybrid_search(index: SparseIndex, queries: DataFrame, qid: str, qtext: str, k: int = 5) -> DataFrame:
    """E11 from a kept index: its blocks for one side, its tokens for the vectors of the other."""
    k2 = 2 * k
    return fuse(sparse_side(index, queries, qid, qtext, k2), dense_side(index.table("tokens"), queries, qid, qtext, k2), k,
                queries.count())


# ---------------------------------------------------------------- registry

def _t(spark, sf_dir):
    from ..session import Tables
    return Tables(spark, sf_dir)


def _q_hybrid(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = hybrid_topk(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", k=5)
    return r.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"),
                    F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"),
                    F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"))


def _q_minmax(spark, sf_dir):
    t = _t(spark, sf_dir)
    index = SparseIndex(spark).add(t.documents, "doc_id", "text")
    s = minmax_normalize(sparse_side(index, t.benchmark, "item_id", "text", 10))
    return s.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"),
                    F.round("norm", 6).alias("norm_score"))


def _q_bm25_score(spark, sf_dir):
    """E3 over a candidate table: the ten nearest documents by vector, scored by BM25."""
    t = _t(spark, sf_dir)
    tokens = tokens_of(t.documents, "doc_id", "text")
    near = dense_side(tokens, t.benchmark, "item_id", "text", 10).select("qid", "doc")
    r = bm25_scores(tokens, t.benchmark, "item_id", "text", pairs=near)
    return r.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def retrieval_ctes(docs: str, dkey: str, dtext: str, qs: str, qkey: str, qtext: str, k2: int = 10) -> str:
    """Oracle CTEs: BM25 (``bm``, top-2k ``sp``, normalised ``spn``) and hashed-vector cosine
    (``ds``, top-2k ``dk``, normalised ``dkn``); keys come out as item_id / doc_id."""
    tok = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
    bucket = r"CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64"
    return f"""
d AS (SELECT {dkey} AS doc_id, {tok.format(dtext)} AS toks FROM {docs}),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY doc_id, term, dl),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT {qkey} AS item_id, unnest({tok.format(qtext)}) AS term FROM {qs}),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY item_id, term),
bm AS (
  SELECT qt.item_id, tf.doc_id,
         sum(qt.qtf * ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1)
             * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / s.avgdl))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN dfreq f ON f.term = qt.term CROSS JOIN stats s
  GROUP BY qt.item_id, tf.doc_id),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rk
                      FROM bm) z WHERE rk <= {k2}),
spn AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS sparse_score
        FROM sp WINDOW w AS (PARTITION BY item_id)),
dt AS (SELECT {dkey} AS doc_id, unnest({tok.format(dtext)}) AS tok FROM {docs}),
db AS (SELECT doc_id, {bucket} AS b, count(*) AS n FROM dt GROUP BY doc_id, b),
dn AS (SELECT dd.{dkey} AS doc_id, coalesce(sqrt(sum(n * n)), 0.0) AS nrm FROM {docs} dd LEFT JOIN db ON db.doc_id = dd.{dkey}
       GROUP BY dd.{dkey}),
qtok AS (SELECT {qkey} AS item_id, unnest({tok.format(qtext)}) AS tok FROM {qs}),
qb AS (SELECT item_id, {bucket} AS b, count(*) AS n FROM qtok GROUP BY item_id, b),
qn AS (SELECT qq.{qkey} AS item_id, coalesce(sqrt(sum(n * n)), 0.0) AS nrm FROM {qs} qq LEFT JOIN qb ON qb.item_id = qq.{qkey}
       GROUP BY qq.{qkey}),
dots AS (SELECT qb.item_id, db.doc_id, sum(qb.n * db.n) AS dp FROM qb JOIN db ON qb.b = db.b GROUP BY qb.item_id, db.doc_id),
ds AS (SELECT qn.item_id, dn.doc_id, coalesce(dots.dp, 0.0) / ((qn.nrm + 1e-10) * (dn.nrm + 1e-10)) AS score
       FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rk
                      FROM ds) z WHERE rk <= {k2}),
dkn AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS dense_score
        FROM dk WINDOW w AS (PARTITION BY item_id))"""


_ALL = retrieval_ctes("documents", "doc_id", "text", "benchmark", "item_id", "text")
SPARSE_CTE = _ALL[:_ALL.index("dt AS (")].rstrip().rstrip(",")
DENSE_CTE = _ALL[_ALL.index("dt AS ("):]

HYBRID_ORACLE = "WITH " + SPARSE_CTE + "," + DENSE_CTE + """,
fz AS (SELECT coalesce(dkn.item_id, spn.item_id) AS item_id, coalesce(dkn.doc_id, spn.doc_id) AS doc_id,
              coalesce(dense_score, 0.0) AS dense_score, coalesce(sparse_score, 0.0) AS sparse_score
       FROM dkn FULL OUTER JOIN spn ON dkn.item_id = spn.item_id AND dkn.doc_id = spn.doc_id),
fr AS (SELECT *, dense_score * 0.6 + sparse_score * 0.4 AS score,
              row_number() OVER (PARTITION BY item_id ORDER BY round(dense_score * 0.6 + sparse_score * 0.4, 9) DESC, doc_id) AS rank
       FROM fz)
SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score,
       round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score FROM fr WHERE rank <= 5"""

MINMAX_ORACLE = "WITH " + SPARSE_CTE + "\nSELECT item_id, doc_id, round(sparse_score, 6) AS norm_score FROM spn"

SCORE_ORACLE = "WITH " + SPARSE_CTE + "," + DENSE_CTE + """
SELECT dk.item_id, dk.doc_id, round(coalesce(bm.score, 0.0), 6) AS score
FROM dk LEFT JOIN bm ON bm.item_id = dk.item_id AND bm.doc_id = dk.doc_id"""

QUERIES = {"minmax_normalize": _q_minmax, "hybrid_topk": _q_hybrid, "bm25_score": _q_bm25_score}
ORACLES = {"minmax_normalize": MINMAX_ORACLE, "hybrid_topk": HYBRID_ORACLE, "bm25_score": SCORE_ORACLE}
