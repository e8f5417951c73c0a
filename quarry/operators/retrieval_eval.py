"""Scoring retrieval runs of all methods in one job.

A *run* is the long table ``(method, qid, doc, rank, score)`` of the sparse,
dense and hybrid top-k for every query.  The corpus is the schema documents
(tables, descriptions, SQL patterns); relevant are the tables named by a
question's gold SQL.  Metrics are joins and group-bys over these tables;
nothing is per-query Python.  Recorded retrieval times enter as a table
``(method, qid, seconds)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import question_type
from ..session import scratch_path
from .sizing import by_query
from .sparse_index import SparseIndex
from .hybrid import DENSE_WEIGHT, SPARSE_WEIGHT, dense_side, fuse, sparse_side

# Method names in their report order.
METHODS = ("dense", "sparse", "hybrid")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs(t, k: int = 5, docs=None, did="doc_id", dtext="text", q=None, qid="item_id", qtext="text") -> DataFrame:
    """Sparse, dense and hybrid top-k of every query.

    Each side is ranked once to 2k (what the fusion needs); the plain top-k
    lists are the first k of those.  The corpus is indexed once; the 2k
    lists (#queries x 2k rows) are written and read by all three methods.
    """
    docs = t.documents if docs is None else docs
    q = t.benchmark if q is None else q
    index = SparseIndex(docs.sparkSession).add(docs, did, dtext)
    sp2 = _written(sparse_side(index, q, qid, qtext, 2 * k), "run_sparse")
    de2 = _written(dense_side(index.table("tokens"), q, qid, qtext, 2 * k), "run_dense")
    sp = sp2.filter(F.col("rank") <= k)
    de = de2.filter(F.col("rank") <= k)
    hy = fuse(sp2, de2, k, q.count())
    cols = ["qid", "doc", "rank", "score"]
    return (sp.select(F.lit("sparse").alias("method"), *cols)
            .unionByName(de.select(F.lit("dense").alias("method"), *cols))
            .unionByName(hy.select(F.lit("hybrid").alias("method"), *cols)))


def _methods(spark) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(METHODS)], "method string, method_order int")


def retrieval_summary(prf: DataFrame, by: list[str] | None = None, times: DataFrame | None = None) -> DataFrame:
    """Mean precision, recall, F1 and case count per method (and group).

    With ``times`` (method, qid, seconds) also their mean and population
    standard deviation.
    """
    keys = (by or []) + ["method"]
    aggs = [F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"),
            F.avg("f1").alias("avg_f1"), F.count(F.lit(1)).alias("total_cases")]
    if times is not None:
        prf = prf.join(times, ["method", "qid"], "left")
        aggs += [F.avg("seconds").alias("avg_time"), F.stddev_pop("seconds").alias("std_time")]
    return prf.groupBy(*keys).agg(*aggs)


def best_method(prf: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Method with the highest mean F1 (first in report order on ties), and the fastest one."""
    s = prf.groupBy("method", "method_order").agg(F.avg("f1").alias("avg_f1"))
    best = s.agg(F.min_by(F.struct("method", "avg_f1"), F.struct(-F.col("avg_f1"), "method_order")).alias("b")).select(
        F.col("b.method").alias("method"), F.col("b.avg_f1").alias("avg_f1"))
    if times is None:
        return best
    fast = times.join(_methods(prf.sparkSession), "method").groupBy("method", "method_order").agg(
        F.avg("seconds").alias("t"))
    fast = fast.agg(F.min_by(F.struct("method", "t"), F.struct("t", "method_order")).alias("f")).select(
        F.col("f.method").alias("fastest"), F.col("f.t").alias("fastest_time"))
    return best.crossJoin(fast)  # one row against one row


def compare_retrievers(run: DataFrame, queries: DataFrame) -> DataFrame:
    """Per method, mean over queries of the mean hit score (0 when none) and mean hit count."""
    spark = run.sparkSession
    per_q = run.groupBy("method", "qid").agg(F.avg("score").alias("ms"), F.count(F.lit(1)).alias("nh"))
    grid = F.broadcast(_methods(spark)).crossJoin(queries)
    j = grid.join(per_q, ["method", "qid"], "left").fillna(0, ["ms", "nh"])
    return j.groupBy("method").agg(F.avg("ms").alias("avg_score"), F.avg("nh").alias("avg_results"))


def schema_retrieval_prf(run: DataFrame, doc_tables: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """E18 on schema retrieval: retrieved tables (lower-cased, blanks dropped) vs the gold SQL's tables.

    ``doc_tables(doc, table)``, ``truth(qid, table)``; an empty relevant set scores 0.
    """
    names = F.collect_set(F.when(F.col("table") != "", F.lower("table")))
    tables = doc_tables.groupBy("doc").agg(names.alias("tables"))  # a row a document
    # one row for each table of a hit, one for a hit without; a hit counts once.  All three
    # inputs are dealt by query once: no step below deals its rows again
    hits = (run.join(tables, "doc", "left").select("qid", "method", F.posexplode_outer("tables").alias("i", "table"))
            .withColumn("hit", (F.coalesce("i", F.lit(0)) == 0).cast("long")).drop("i"))
    n = queries.count()
    hits, truth, queries = by_query(hits, n), by_query(truth, n), by_query(queries, n)
    once = hits.groupBy("qid", "method", "table").agg(F.sum("hit").alias("hit"))
    rel = truth.groupBy("qid").agg(F.collect_list("table").alias("rel"))
    none = F.array().cast("array<string>")
    seen = once.join(rel, "qid", "left").withColumn(
        "rr", F.size(F.filter(F.coalesce("rel", none), lambda x: x == F.col("table"))))
    own = [F.col("method") == m for m in METHODS]
    sums = seen.groupBy("qid").agg(*[f(F.when(m, F.col(x))).alias(f"{x}_{i}") for i, m in enumerate(own)
                                     for f, x in ((F.sum, "hit"), (F.count, "table"), (F.sum, "rr"))])
    zero = F.lit(0).cast("long")
    lines = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("method_order"), *[
        F.coalesce(f"{x}_{i}", zero).alias(name) for x, name in (("hit", "num_retrieved"), ("table", "n_set"), ("rr", "rr"))])
        for i, m in enumerate(METHODS)])
    j = (queries.join(rel, "qid", "left").join(sums, "qid", "left")
         .select("qid", F.size(F.coalesce("rel", none)).alias("n_rel"), F.inline(lines)))
    has = F.col("n_rel") > 0
    p = F.when(has & (F.col("n_set") > 0), F.col("rr") / F.col("n_set")).otherwise(0.0)
    r = F.when(has, F.col("rr") / F.col("n_rel")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return j.select("method", "method_order", "qid", p.alias("precision"), r.alias("recall"), f1.alias("f1"),
                    F.col("num_retrieved").cast("long").alias("num_retrieved"),
                    F.when(has, F.col("rr")).otherwise(0).cast("long").alias("relevant_retrieved"))


# ---------------------------------------------------------------- registry

def _t(spark, sf_dir):
    from ..session import Tables
    return Tables(spark, sf_dir)


# Recorded seconds of every query and method: ONE SQL text run by both engines.
TIMES_SQL = """
SELECT method, qid, CAST(qid % 100 + method_order * 7 + 1 AS DOUBLE) / 1000 AS seconds
FROM query_log CROSS JOIN (SELECT 'dense' AS method, 0 AS method_order UNION ALL SELECT 'sparse', 1
                           UNION ALL SELECT 'hybrid', 2) m"""


def _times(t) -> DataFrame:
    from ..plans.derived import query_log
    m = _methods(t.spark)
    return query_log(t).select("qid").crossJoin(F.broadcast(m)).select(  # three methods
        "method", "qid",
        ((F.col("qid") % 100 + F.col("method_order") * 7 + 1).cast("double") / 1000).alias("seconds"))


_METRICS = ("avg_precision", "avg_recall", "avg_f1")


def _q_prf(spark, sf_dir):
    p = _schema_prf(_t(spark, sf_dir), values=False)
    return p.select("method", "qid", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"),
                    "num_retrieved", "relevant_retrieved")


def _q_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = retrieval_summary(_schema_prf(t, values=False), times=_times(t))
    return s.select("method", *[F.round(x, 6).alias(x) for x in (*_METRICS, "avg_time", "std_time")], "total_cases")


def _q_by_type(spark, sf_dir):
    from ..plans.derived import query_log
    t = _t(spark, sf_dir)
    types = query_log(t).select("qid", F.coalesce(question_type("question"), F.lit("unknown")).alias("query_type"))
    s = retrieval_summary(_schema_prf(t, values=False).join(types, "qid"), ["query_type"], _times(t))
    return s.select("query_type", "method", *[F.round(x, 6).alias(x) for x in (*_METRICS, "avg_time", "std_time")],
                    "total_cases")


def _q_best(spark, sf_dir):
    t = _t(spark, sf_dir)
    b = best_method(_schema_prf(t, values=False), _times(t))
    return b.select("method", F.round("avg_f1", 6).alias("avg_f1"), "fastest",
                    F.round("fastest_time", 6).alias("fastest_time"))


def _q_compare(spark, sf_dir):
    t = _t(spark, sf_dir)
    c = compare_retrievers(runs(t), t.benchmark.select(F.col("item_id").alias("qid")))
    return c.select("method", F.round("avg_score", 6).alias("avg_score"), F.round("avg_results", 6).alias("avg_results"))


def _q_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    n = t.documents.agg(F.count(F.lit(1)).alias("num_documents"))
    m = _methods(spark)
    return (F.broadcast(m).crossJoin(n).select(
        "method", "num_documents",
        F.when(F.col("method") == "hybrid", F.lit(DENSE_WEIGHT)).alias("dense_weight"),
        F.when(F.col("method") == "hybrid", F.lit(SPARSE_WEIGHT)).alias("sparse_weight")))


def _oracle_runs():
    from .hybrid import DENSE_CTE, SPARSE_CTE
    return "WITH " + SPARSE_CTE + "," + DENSE_CTE + """,
fz AS (SELECT coalesce(dkn.item_id, spn.item_id) AS item_id, coalesce(dkn.doc_id, spn.doc_id) AS doc_id,
              coalesce(dense_score, 0.0) * 0.6 + coalesce(sparse_score, 0.0) * 0.4 AS score
       FROM dkn FULL OUTER JOIN spn ON dkn.item_id = spn.item_id AND dkn.doc_id = spn.doc_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM fz) z WHERE rk <= 5),
runs AS (SELECT 'sparse' AS method, item_id, doc_id, score FROM sp WHERE rk <= 5
         UNION ALL SELECT 'dense', item_id, doc_id, score FROM dk WHERE rk <= 5
         UNION ALL SELECT 'hybrid', item_id, doc_id, score FROM hy),
m AS (SELECT * FROM (VALUES ('dense', 0), ('sparse', 1), ('hybrid', 2)) v(method, method_order)),
grid AS (SELECT method, method_order, item_id FROM m CROSS JOIN benchmark)
"""


ORACLES = {
    "compare_retrievers": _oracle_runs() + """,
pq AS (SELECT method, item_id, avg(score) AS ms, count(*) AS nh FROM runs GROUP BY method, item_id)
SELECT g.method, round(avg(coalesce(ms, 0.0)), 6) AS avg_score, round(avg(coalesce(nh, 0)), 6) AS avg_results
FROM grid g LEFT JOIN pq USING (method, item_id) GROUP BY g.method""",
    "retriever_stats": """
SELECT method, (SELECT count(*) FROM documents) AS num_documents,
       CASE WHEN method = 'hybrid' THEN 0.6 END AS dense_weight, CASE WHEN method = 'hybrid' THEN 0.4 END AS sparse_weight
FROM (VALUES ('dense'), ('sparse'), ('hybrid')) v(method)""",
}

def _schema_prf(t, values: bool = True):
    from ..functions.sqltext import relevant_tables
    from ..plans.derived import query_log
    from .schema_docs import schema_docs
    docs = _written(schema_docs(t, values).select(F.col("pos").alias("doc"), "content", "table"), "schema_docs")
    ql = query_log(t)
    q = ql.select("qid", "question")
    run = runs(t, 5, docs.select("doc", "content"), "doc", "content", q, "qid", "question")
    truth = ql.select("qid", F.explode(relevant_tables("gold_sql", t.available())).alias("table"))
    return schema_retrieval_prf(run, docs.select("doc", "table"), truth, ql.select("qid"))


def _q_schema_prf(spark, sf_dir):
    p = _schema_prf(_t(spark, sf_dir))
    return p.select("method", "qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round("f1", 6).alias("f1"), "num_retrieved", "relevant_retrieved")


def _q_schema_summary(spark, sf_dir):
    s = retrieval_summary(_schema_prf(_t(spark, sf_dir)))
    return s.select("method", *[F.round(x, 6).alias(x) for x in ("avg_precision", "avg_recall", "avg_f1")],
                    "total_cases")


def _schema_oracle_runs(values: bool = True):
    from ..plans.derived import QUERY_LOG_SQL
    from ..session import TABLE_NAMES
    from .hybrid import retrieval_ctes
    from .schema_docs import ORACLES as SD
    docs_sql = SD["schema_docs"]
    docs_body = docs_sql[len("WITH "):docs_sql.rindex("SELECT pos, id, type")].rstrip().rstrip(",")
    if not values:
        docs_body = docs_body.replace("\ndocs AS (", "\nall_docs AS (") + (
            ",\ndocs AS (SELECT * FROM all_docs WHERE type <> 'column_values')")
    rel = ", ".join(
        rf"CASE WHEN regexp_matches(lower(gold_sql), '\bfrom\s+{n}\b|\bjoin\s+{n}\b|\b{n}\s+as\b|\b{n}\.') "
        f"THEN '{n}' END" for n in TABLE_NAMES)
    return ("WITH " + docs_body + f",\nquery_log AS ({QUERY_LOG_SQL}),"
            + retrieval_ctes("docs", "pos", "content", "query_log", "qid", "question") + f""",
fz AS (SELECT coalesce(dkn.item_id, spn.item_id) AS item_id, coalesce(dkn.doc_id, spn.doc_id) AS doc_id,
              coalesce(dense_score, 0.0) * 0.6 + coalesce(sparse_score, 0.0) * 0.4 AS score
       FROM dkn FULL OUTER JOIN spn ON dkn.item_id = spn.item_id AND dkn.doc_id = spn.doc_id),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rk FROM fz) z WHERE rk <= 5),
runs AS (SELECT 'sparse' AS method, item_id, doc_id FROM sp WHERE rk <= 5
         UNION ALL SELECT 'dense', item_id, doc_id FROM dk WHERE rk <= 5
         UNION ALL SELECT 'hybrid', item_id, doc_id FROM hy),
truth AS (SELECT DISTINCT qid AS item_id, unnest(list_filter([{rel}], lambda x: x IS NOT NULL)) AS tbl FROM query_log),
got AS (SELECT DISTINCT r.method, r.item_id, lower(d."table") AS tbl FROM runs r JOIN docs d ON d.pos = r.doc_id
        WHERE d."table" IS NOT NULL AND d."table" <> ''),
m AS (SELECT * FROM (VALUES ('dense', 0), ('sparse', 1), ('hybrid', 2)) v(method, method_order)),
grid AS (SELECT method, method_order, qid AS item_id FROM m CROSS JOIN query_log),
nret AS (SELECT method, item_id, count(*) AS num_retrieved FROM runs GROUP BY method, item_id),
nset AS (SELECT method, item_id, count(*) AS n_set FROM got GROUP BY method, item_id),
nrel AS (SELECT item_id, count(*) AS n_rel FROM truth GROUP BY item_id),
bth AS (SELECT g.method, g.item_id, count(*) AS rr FROM got g JOIN truth t ON t.item_id = g.item_id AND t.tbl = g.tbl
        GROUP BY g.method, g.item_id),
j AS (SELECT grid.method, grid.method_order, grid.item_id, coalesce(num_retrieved, 0) AS num_retrieved,
             coalesce(n_set, 0) AS n_set, coalesce(n_rel, 0) AS n_rel, coalesce(rr, 0) AS rr
      FROM grid LEFT JOIN nret USING (method, item_id) LEFT JOIN nset USING (method, item_id)
      LEFT JOIN nrel USING (item_id) LEFT JOIN bth USING (method, item_id)),
pr AS (SELECT *, CASE WHEN n_rel > 0 AND n_set > 0 THEN rr / n_set ELSE 0.0 END AS p,
              CASE WHEN n_rel > 0 THEN rr / n_rel ELSE 0.0 END AS r FROM j),
prf AS (SELECT method, method_order, item_id, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1,
               CAST(num_retrieved AS BIGINT) AS num_retrieved,
               CAST(CASE WHEN n_rel > 0 THEN rr ELSE 0 END AS BIGINT) AS relevant_retrieved FROM pr)
""")


ORACLES["schema_retrieval_prf"] = _schema_oracle_runs() + """
SELECT method, item_id AS qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       num_retrieved, relevant_retrieved FROM prf"""
ORACLES["schema_retrieval_summary"] = _schema_oracle_runs() + """
SELECT method, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall,
       round(avg(f1), 6) AS avg_f1, count(*) AS total_cases FROM prf GROUP BY method"""

_TIMED = _schema_oracle_runs(False) + f""", tm AS ({TIMES_SQL}),
pt AS (SELECT prf.*, seconds FROM prf JOIN tm ON tm.method = prf.method AND tm.qid = prf.item_id)
"""
_MEANS = """round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1,
  round(avg(seconds), 6) AS avg_time, round(stddev_pop(seconds), 6) AS std_time, count(*) AS total_cases"""


def _type_sql():
    from ..plans import duck as D
    return D.question_type("question")


ORACLES |= {
    "retrieval_prf": _schema_oracle_runs(False) + """
SELECT method, item_id AS qid, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       num_retrieved, relevant_retrieved FROM prf""",
    "retrieval_summary": _TIMED + f"SELECT method, {_MEANS} FROM pt GROUP BY method",
    "retrieval_by_type": _TIMED + f"""
SELECT query_type, method, {_MEANS}
FROM pt JOIN (SELECT qid, coalesce({_type_sql()}, 'unknown') AS query_type FROM query_log) ty ON ty.qid = pt.item_id
GROUP BY query_type, method""",
    "retrieval_best": _TIMED + """
SELECT b.method, round(b.avg_f1, 6) AS avg_f1, f.method AS fastest, round(f.t, 6) AS fastest_time
FROM (SELECT method, method_order, avg(f1) AS avg_f1 FROM prf GROUP BY ALL ORDER BY avg_f1 DESC, method_order LIMIT 1) b,
     (SELECT method, avg(seconds) AS t FROM tm GROUP BY method ORDER BY t LIMIT 1) f""",
}

QUERIES = {
    "schema_retrieval_prf": _q_schema_prf,
    "schema_retrieval_summary": _q_schema_summary,
    "retrieval_prf": _q_prf,
    "retrieval_summary": _q_summary,
    "retrieval_by_type": _q_by_type,
    "retrieval_best": _q_best,
    "compare_retrievers": _q_compare,
    "retriever_stats": _q_stats,
}
