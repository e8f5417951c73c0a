"""BM25 sparse retrieval as an inverted-index join (E3, and E4 over small corpora).

The kept index and its top-k over blocks are in ``sparse_index``.

Instead of scoring every document for every query, the corpus is exploded
into postings ``(doc, term, tf, dl)`` restricted to the query vocabulary,
joined with the query terms and summed per ``(query, doc)``.  Documents
sharing no term with a query never appear, which is the same as keeping
only positive scores.

Scale notes
* postings are combined map-side per document before the shuffle, so a
  very frequent term ("the") costs one row per document, not per token;
* joins carry no hints: Spark shares the query terms with all tasks where
  their measured size allows, and splits a frequent term's rows where not;
* the per-query top-k is ``row_number() <= k`` which Spark turns into a
  partial ``WindowGroupLimit`` ahead of the shuffle: a query that matches a
  third of the corpus still sends only k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import scratch_path
from .sizing import by_query, spread

# BM25 defaults.
K1 = 1.5
B = 0.75


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term, qtf): a token repeated in the query counts that many times."""
    return (queries.select(F.col(qid).alias("qid"), F.explode(tokenize(text)).alias("term"))
            .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def tokens_of(docs: DataFrame, did: str, text: str) -> DataFrame:
    """(doc, toks) written once: postings, statistics and hashed vectors all read this table."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    tok = spread(docs).select(F.col(did).alias("doc"), tokenize(text).alias("toks"))
    tok.write.parquet(path)
    return spark.read.schema(tok.schema).parquet(path)


# Tokens of a task that counts terms: its groups take about 100 bytes each.
COUNTED = 1_000_000


def postings(tokens: DataFrame, length: int) -> DataFrame:
    """(doc, term, dl, tf) of every term of every document; ``length`` is the number of tokens.

    Documents are dealt whole, over tasks that grow with the tokens; their
    terms are counted there and not shuffled.
    """
    tasks = max(-(-length // COUNTED), tokens.sparkSession.sparkContext.defaultParallelism)
    dealt = tokens.select("doc", F.size("toks").alias("dl"), "toks").repartition(tasks, "doc", "dl")
    ex = dealt.select("doc", "dl", F.explode("toks").alias("term"))
    return ex.groupBy("doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(tokens: DataFrame) -> tuple[int, float]:
    """Number of documents and mean length; a document without tokens has length 0."""
    r = tokens.agg(F.count(F.lit(1)), F.sum(F.size("toks"))).head()
    return r[0], (r[1] / r[0] if r[0] else 0.0)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _weights(tokens: DataFrame, queries: DataFrame, qid: str, qtext: str, k1: float, b: float):
    """(query term weights, postings with their part of the score, number of documents).

    Weights are (qid, term, w, df); postings (doc, term, p) hold the terms of
    the queries only; a term gives a document ``w * p``, with ``p < k1 + 1``.
    """
    qt = query_terms(queries, qid, qtext)
    n_docs, avgdl = corpus_stats(tokens)
    ex = tokens.select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("term")).join(
        qt.select("term").distinct(), "term", "left_semi")
    p = F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl if avgdl else 1.0)))
    post = ex.groupBy("doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select("doc", "term", p.alias("p"))
    post = _written(post, "bm25_postings")
    df_ = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = qt.join(df_, "term").select("qid", "term", (F.col("qtf") * idf_of(F.col("df"), n_docs)).alias("w"), "df")
    return _written(w, "bm25_weights"), post, n_docs


def bm25_scores(tokens: DataFrame, queries: DataFrame, qid: str, qtext: str, pairs: DataFrame | None = None,
                k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc, score) for every document sharing a term with the query.

    ``tokens`` comes from :func:`tokens_of`.  With ``pairs`` (qid, doc) only
    those pairs are scored, 0 where they share no term.
    """
    w, post, _ = _weights(tokens, queries, qid, qtext, k1, b)
    if pairs is None:
        return _sum(w.join(post, "term"))
    scored = _sum(w.join(pairs.select("qid", "doc"), "qid").join(post, ["doc", "term"]))
    return pairs.select("qid", "doc").join(scored, ["qid", "doc"], "left").fillna(0.0, ["score"])


def _sum(hit: DataFrame) -> DataFrame:
    return hit.groupBy("qid", "doc").agg(F.sum(F.col("w") * F.col("p")).alias("score"))


# A term in more than this share of the documents is left for the second step.
FREQUENT = 0.1
# Slack of the bounds, above the rounding of sums and of the ranking.
SLACK = 1e-6


# Documents up to which no block or bound can rule anything out: one block of a term holds all of them.
FEW = 128


def topk_in_full(queries: DataFrame, qid: str, qtext: str, gives: DataFrame, k: int) -> DataFrame:
    """Top-k over few documents: (qid, doc, score, rank) from ``gives`` (term, doc, p), what a term gives a document.

    The queries are many, so they are dealt by ``qid`` once, as texts: counting
    their words, summing and ranking need no other shuffle where Spark shares
    the small table with all tasks.
    """
    own = queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("text")).where(F.col("qid").isNotNull())
    asked = query_terms(by_query(own, queries.count()), "qid", "text")
    return top_k(asked.join(gives, "term").groupBy("qid", "doc").agg(F.sum(F.col("qtf") * F.col("p")).alias("score")), k)


def idf_of(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(float(n_docs)) - df + 0.5) / (df + 0.5) + 1.0)


def bm25_topk(tokens: DataFrame, queries: DataFrame, qid: str, qtext: str, k: int,
              k1: float = K1, b: float = B) -> DataFrame:
    """Exact top-k without scoring every pair that shares a frequent word.

    Rare terms are scored first.  A query's k-th best of these is a lower
    bound of its result; a document stays only if its rare terms plus the most
    that the frequent terms can give reach the bound, and just these are
    completed.  A query whose frequent terms alone could reach its bound, or
    with fewer than k documents, is scored in full; so are all over few documents.
    """
    n_docs, avgdl = corpus_stats(tokens)
    if n_docs <= FEW:
        p = F.col("tf") * (k1 + 1) / (
            F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl if avgdl else 1.0)))
        post = _written(postings(tokens, int(n_docs * avgdl)).select("doc", "term", p.alias("p")), "bm25_postings")
        df_ = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        gives = post.join(df_, "term").select("term", "doc", (F.col("p") * idf_of(F.col("df"), n_docs)).alias("p"))
        return topk_in_full(queries, qid, qtext, _written(gives, "bm25_gives"), k)
    w, post, n_docs = _weights(tokens, queries, qid, qtext, k1, b)
    rare, often = w.where(F.col("df") <= FREQUENT * n_docs), w.where(F.col("df") > FREQUENT * n_docs)
    part = _written(_sum(rare.join(post, "term")), "bm25_partial")
    low = top_k(part, k).groupBy("qid").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("m")).where(
        F.col("m") == k)
    more = often.groupBy("qid").agg((F.sum("w") * (k1 + 1)).alias("more"))
    state = (w.select("qid").distinct().join(low, "qid", "left").join(more, "qid", "left")
             .select("qid", "low", F.coalesce("more", F.lit(0.0)).alias("more"))
             .withColumn("bounded", F.coalesce(F.col("more") < F.col("low") - SLACK, F.lit(False))))
    state = _written(state, "bm25_bounds")
    stay = part.join(state.where("bounded"), "qid").where(
        F.col("score") + F.col("more") >= F.col("low") - SLACK).select("qid", "doc", F.col("score").alias("partial"))
    rest = _sum(stay.join(often, "qid").join(post, ["doc", "term"])).withColumnRenamed("score", "rest")
    done = stay.join(rest, ["qid", "doc"], "left").select(
        "qid", "doc", (F.col("partial") + F.coalesce("rest", F.lit(0.0))).alias("score"))
    full = _sum(w.join(state.where(~F.col("bounded")).select("qid"), "qid", "left_semi").join(post, "term"))
    return top_k(done.unionByName(full), k)


def top_k(scored: DataFrame, k: int, part: str = "qid", score: str = "score",
          tie: str = "doc", rank: str = "rank") -> DataFrame:
    """Per-partition top-k, ties broken by ``tie`` ascending (index order)."""
    # Scores are sums of floats whose order differs between engines; equal
    # documents (exact copies) must tie, so rank on the score to 9 digits.
    w = Window.partitionBy(part).orderBy(F.round(F.col(score), 9).desc(), F.col(tie).asc())
    return (scored.withColumn(rank, F.row_number().over(w))
            .filter(F.col(rank) <= k))


def sparse_topk(docs: DataFrame, did: str, dtext: str, queries: DataFrame, qid: str, qtext: str,
                k: int = 5) -> DataFrame:
    """Top-k documents by BM25 per query, positive scores only, from an index of its own.

    To search often, keep a ``SparseIndex`` and call its ``topk``.
    """
    from .sparse_index import SparseIndex
    return SparseIndex(docs.sparkSession).add(docs, did, dtext).topk(queries, qid, qtext, k)


# ---------------------------------------------------------------- registry

def _q_sparse_topk(spark, sf_dir):
    from ..session import Tables
    t = Tables(spark, sf_dir)
    r = sparse_topk(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", k=5)
    return r.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"),
                    F.col("rank").cast("long").alias("rank"),
                    F.round("score", 6).alias("score"))


def _q_bm25_index(spark, sf_dir):
    """A kept index of two batches: document frequency and count of every term, plus statistics."""
    from ..session import Tables
    from .sparse_index import SparseIndex
    docs = Tables(spark, sf_dir).documents
    odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    index = SparseIndex(spark).add(docs.where(~odd), "doc_id", "text").add(docs.where(odd), "doc_id", "text")
    n_docs, avgdl = index.stats()
    return index.terms().select("term", "df", "ctf", F.lit(n_docs).cast("long").alias("n_docs"),
                                F.round(F.lit(avgdl), 6).alias("avgdl"))


def _q_tokenize(spark, sf_dir):
    """Token count and distinct token count per document."""
    from ..session import Tables
    t = Tables(spark, sf_dir)
    toks = tokenize("text")
    return t.documents.select("doc_id", F.size(toks).cast("long").alias("n_tokens"),
                              F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"),
                              F.coalesce(F.element_at(toks, 1), F.lit("")).alias("first_token"))


_DOC_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

SPARSE_ORACLE = f"""
WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM post GROUP BY doc_id, term, dl),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest({_DOC_TOKENS}) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY item_id, term),
sc AS (
  SELECT qt.item_id, tf.doc_id,
         sum(qt.qtf * ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1)
             * tf.tf * 2.5 / (tf.tf + 1.5 * (1 - 0.75 + 0.75 * tf.dl / s.avgdl))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN dfreq f ON f.term = qt.term CROSS JOIN stats s
  GROUP BY qt.item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5
"""

INDEX_ORACLE = f"""
WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS toks FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
post AS (SELECT doc_id, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM post GROUP BY doc_id, term)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf, s.n_docs, round(s.avgdl, 6) AS avgdl
FROM tf CROSS JOIN stats s GROUP BY term, s.n_docs, s.avgdl
"""

TOKENIZE_ORACLE = f"""
SELECT doc_id, CAST(len({_DOC_TOKENS}) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct({_DOC_TOKENS})) AS BIGINT) AS n_distinct,
       coalesce({_DOC_TOKENS}[1], '') AS first_token
FROM documents
"""

QUERIES = {
    "tokenize": _q_tokenize,
    "bm25_index": _q_bm25_index,
    "sparse_topk": _q_sparse_topk,
}

ORACLES = {
    "tokenize": TOKENIZE_ORACLE,
    "bm25_index": INDEX_ORACLE,
    "sparse_topk": SPARSE_ORACLE,
}
