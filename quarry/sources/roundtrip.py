"""Registered queries for sources, sinks and the vector store.

Files are written under a fresh folder of the session's checkpoint
directory (the cluster's shared folder) and read back with explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sqltext import hardness
from ..operators.dense import hashed_vector
from ..plans import duck as D
from ..plans.derived import EVAL_RESULTS_SQL, PIPELINES, QUERY_LOG_SQL, eval_results, query_log
from ..plans.reports import ER, combined_totals, pipeline_summary, scored
from ..session import TABLE_NAMES, Tables, scratch_path
from . import files as FL
from .vector_store import VectorStore


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _examples(t):
    return query_log(t).select("db_id", "question", F.col("gold_sql").alias("query"),
                               hardness("gold_sql").alias("hardness"))


def _schema_entries(t):
    """Schema JSON entries: every db of the split but the last one; the first db twice (later copy wins)."""
    dbs = query_log(t).select("db_id").distinct()
    keep = dbs.filter(F.col("db_id") != "5-LOW")
    full = keep.select(F.concat(F.lit("1"), "db_id").alias("place"), "db_id",
                       F.array(*[F.lit(n) for n in TABLE_NAMES]).alias("table_names_original"))
    stale = keep.filter(F.col("db_id") == "1-URGENT").select(
        F.lit("0").alias("place"), "db_id", F.array(F.lit("orders")).alias("table_names_original"))
    return full.unionByName(stale)


def _q_load_split(spark, sf_dir):
    t = _t(spark, sf_dir)
    base = scratch_path(spark, "split")
    FL.write_json(_examples(t), base + "/dev")
    FL.write_json_array(_schema_entries(t), "place", base + "/tables")
    known = FL.load_schema_json(spark, base + "/tables")
    return FL.load_split(spark, base + "/dev", known)


# Questions the limited split is read to.
FIRST_QUESTIONS = 100


def _q_load_split_limit(spark, sf_dir):
    """The first hundred questions of a split in the order of its files, then those of known databases."""
    t = _t(spark, sf_dir)
    base = scratch_path(spark, "split")
    by_id = query_log(t).select("qid", "db_id", "question", F.col("gold_sql").alias("query"),
                                hardness("gold_sql").alias("hardness")).orderBy("qid")
    FL.write_json(by_id.drop("qid"), base + "/dev")
    FL.write_json_array(_schema_entries(t), "place", base + "/tables")
    return FL.load_split(spark, base + "/dev", FL.load_schema_json(spark, base + "/tables"), FIRST_QUESTIONS)


def _q_load_schema_json(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = scratch_path(spark, "tables")
    FL.write_json_array(_schema_entries(t), "place", path)
    s = FL.load_schema_json(spark, path)
    return s.select("db_id", F.explode("table_names_original").alias("table_name"))


def _q_to_test_cases(spark, sf_dir):
    t = _t(spark, sf_dir)
    tc = FL.to_test_cases(_examples(t), list(TABLE_NAMES))
    return tc.select("question", "db_id", "hardness", "gold_sql",
                     F.array_join("relevant_tables", ",").alias("relevant_tables"))


def _q_load_test_cases(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = scratch_path(spark, "cases")
    FL.write_json(FL.to_test_cases(_examples(t), list(TABLE_NAMES)), path)
    return FL.load_test_cases(spark, path).withColumn("relevant_tables", F.array_join("relevant_tables", ","))


def _wide(t):
    return FL.detail_wide(scored(eval_results(t)), PIPELINES)


def _q_detail(spark, sf_dir):
    w = _wide(_t(spark, sf_dir))
    cols = ["id", "question", "hardness", "gold_sql"]
    for p in PIPELINES:
        cols += [F.col(f"{p}_SQL"), F.col(f"{p}_Correct"), F.round(f"{p}_Time", 6).alias(f"{p}_Time")]
    return w.select(*cols)


def _q_detail_roundtrip(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = FL.write_detail_csv(_wide(t), PIPELINES, scratch_path(spark, "detail_csv"))
    return FL.read_detail_csv(spark, path)


def _read_csv(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _q_summary_csv(spark, sf_dir):
    t = _t(spark, sf_dir)
    txt = FL.summary_text(pipeline_summary(eval_results(t), ("pipeline",)))
    return _read_csv(spark, FL.write_csv(txt, scratch_path(spark, "summary_csv")))


def _q_combined_csv(spark, sf_dir):
    t = _t(spark, sf_dir)
    txt = FL.combined_text(combined_totals(eval_results(t)))
    return _read_csv(spark, FL.write_csv(txt, scratch_path(spark, "combined_csv")))


def _q_detail_json(spark, sf_dir):
    t = _t(spark, sf_dir)
    d = FL.detail_json(scored(eval_results(t)))
    path = scratch_path(spark, "detail_json")
    d.write.mode("overwrite").json(path)
    back = spark.read.schema(d.schema).json(path)
    rows = back.select("db_id", "id", "question", "gold_sql", "hardness", F.explode("pipelines").alias("pipeline", "o"))
    return rows.select("db_id", "id", "question", "gold_sql", "hardness", "pipeline", *[
        F.round(f"o.{f}", 6).alias(f) if f in ("execution_time", "component_score") else F.col(f"o.{f}")
        for f in FL.DETAIL_FIELDS])


def _q_combined_json(spark, sf_dir):
    t = _t(spark, sf_dir)
    c = FL.combined_json(pipeline_summary(eval_results(t)))
    path = scratch_path(spark, "combined_json")
    c.write.mode("overwrite").json(path)
    rows = spark.read.schema(c.schema).json(path).select("*", F.explode("per_database").alias("db_id", "d"))
    return rows.select("pipeline", "total_questions", "correct_answers",
                       F.round("execution_accuracy", 6).alias("execution_accuracy"),
                       F.round("total_time_seconds", 4).alias("total_time_seconds"), "db_id",
                       F.col("d.total_questions").alias("db_questions"),
                       F.round("d.execution_accuracy", 6).alias("db_accuracy"),
                       F.round("d.avg_time_per_question", 6).alias("db_avg_time"))


def _q_result_csv(spark, sf_dir):
    t = _t(spark, sf_dir)
    res = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return _read_csv(spark, FL.write_csv(res, scratch_path(spark, "result_csv")))


def _labelled(t):
    return t.embeddings.select("vec_id", F.concat(F.lit("label "), F.col("label").cast("string")).alias("content"),
                               F.concat(F.lit("label_"), F.col("label").cast("string")).alias("db_name"), "embedding")


def _store(t):
    return FL.store_add(None, _labelled(t), "vec_id", "content", "db_name", "embedding", "vec_id")


def _q_store_roundtrip(spark, sf_dir):
    t = _t(spark, sf_dir)
    path = FL.store_save(_store(t), scratch_path(spark, "store"))
    back = FL.store_load(spark, path)
    return back.select("id", "seq", "db_name", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
                       .alias("sum_v"))


def _q_store_save(spark, sf_dir):
    """A19 save: the store written partitioned by database; per-partition counts read from the files."""
    t = _t(spark, sf_dir)
    path = FL.store_save(_store(t), scratch_path(spark, "store"))
    return spark.read.parquet(path).groupBy("db_name").agg(F.count(F.lit(1)).alias("n_docs"),
                                                          F.min("seq").alias("first_seq"))


def _q_store_load(spark, sf_dir):
    """A19 load: the saved store read back (None only when nothing was saved there)."""
    t = _t(spark, sf_dir)
    path = FL.store_save(_store(t), scratch_path(spark, "store"))
    back = FL.store_load(spark, path)
    return back.select("id", "seq", "db_name", "content",
                       F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_v"))


def _added(spark, t):
    """Three batches appended to a saved store, the last under ids of the first."""
    store = VectorStore(spark)
    store.add(_labelled(t), "vec_id", "content", "db_name", "embedding", "vec_id")
    b = t.benchmark.select("item_id", F.lit("bench").alias("db_name"), "text", hashed_vector("text").alias("v"))
    store.add(b, None, "text", "db_name", "v", "item_id")
    again = t.embeddings.select("vec_id", F.lit("v2").alias("content"), F.lit("label_again").alias("db_name"), "embedding")
    return VectorStore(spark, store.path).add(again, "vec_id", "content", "db_name", "embedding", "vec_id")


def _q_store_add(spark, sf_dir):
    g = _added(spark, _t(spark, sf_dir)).get()
    return g.select("id", "seq", "db_name", F.md5("content").alias("content_md5"))


def _q_store_get(spark, sf_dir):
    t = _t(spark, sf_dir)
    ids = t.embeddings.filter(F.col("label") == 3).select(F.col("vec_id").cast("string").alias("id"))
    g = _added(spark, t).get(ids)
    return g.select("id", "seq", "content", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6)
                    .alias("sum_v"))


_UNIT_SUM = "round(list_sum(list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10))), 6)"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

ORACLES = {
    "to_test_cases": f"WITH query_log AS ({QUERY_LOG_SQL})\n" + f"""
SELECT question, db_id, {D.hardness('gold_sql')} AS hardness, gold_sql,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(
      rf"CASE WHEN regexp_matches(lower(gold_sql), '\bfrom\s+{n}\b|\bjoin\s+{n}\b|\b{n}\s+as\b|\b{n}\.') THEN '{n}' END"
      for n in TABLE_NAMES)}], lambda x: x IS NOT NULL))), ',') AS relevant_tables
FROM query_log""",
    "sink_csv_detail": f"WITH er AS ({EVAL_RESULTS_SQL})\n" + """
SELECT id, question, hardness, gold_sql, """ + ", ".join(
        f"coalesce(first(generated_sql) FILTER (WHERE pipeline = '{p}'), '') AS {p}_SQL, "
        f"coalesce(first(CASE WHEN generated_sql <> '' AND correct THEN 'Yes' ELSE 'No' END) FILTER (WHERE pipeline = '{p}'), 'No') AS {p}_Correct, "
        f"round(coalesce(first(execution_time) FILTER (WHERE pipeline = '{p}'), 0.0), 6) AS {p}_Time" for p in PIPELINES) + """
FROM er GROUP BY id, question, hardness, gold_sql""",
    "sink_csv_detail_roundtrip": f"WITH er AS ({EVAL_RESULTS_SQL})\n" + """
SELECT CAST(id AS VARCHAR) AS "ID", question AS "Question", hardness AS "Hardness", gold_sql AS "Gold SQL", """ + ", ".join(
        f"nullif(coalesce(first(generated_sql) FILTER (WHERE pipeline = '{p}'), ''), '') AS {p}_SQL, "
        f"coalesce(first(CASE WHEN generated_sql <> '' AND correct THEN 'Yes' ELSE 'No' END) FILTER (WHERE pipeline = '{p}'), 'No') AS {p}_Correct, "
        f"printf('%.1f', coalesce(first(execution_time) FILTER (WHERE pipeline = '{p}'), 0.0)) AS {p}_Time" for p in PIPELINES) + """
FROM er GROUP BY id, question, hardness, gold_sql""",
    "load_split": f"WITH query_log AS ({QUERY_LOG_SQL})\n" + f"""
SELECT db_id, question, gold_sql AS query, {D.hardness('gold_sql')} AS hardness FROM query_log WHERE db_id <> '5-LOW'""",
    "load_split_limit": f"WITH query_log AS ({QUERY_LOG_SQL})\n" + f"""
SELECT db_id, question, gold_sql AS query, {D.hardness('gold_sql')} AS hardness
FROM (SELECT * FROM query_log ORDER BY qid LIMIT {FIRST_QUESTIONS}) z WHERE db_id <> '5-LOW'""",
    "load_schema_json": f"WITH query_log AS ({QUERY_LOG_SQL})\n" + f"""
SELECT db_id, unnest([{', '.join(f"'{n}'" for n in TABLE_NAMES)}]) AS table_name
FROM (SELECT DISTINCT db_id FROM query_log WHERE db_id <> '5-LOW') z""",
    "load_test_cases": f"WITH query_log AS ({QUERY_LOG_SQL})\n" + f"""
SELECT question, 'db/' || db_id AS db_path, gold_sql, db_id, {D.hardness('gold_sql')} AS hardness,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(
      rf"CASE WHEN regexp_matches(lower(gold_sql), '\bfrom\s+{n}\b|\bjoin\s+{n}\b|\b{n}\s+as\b|\b{n}\.') THEN '{n}' END"
      for n in TABLE_NAMES)}], lambda x: x IS NOT NULL))), ',') AS relevant_tables, 'unknown' AS query_type
FROM query_log""",
    "sink_csv_summary": ER + """
SELECT replace(pipeline, '_', ' ') AS "Pipeline", CAST(count(*) AS VARCHAR) AS "Total Questions", """ + ", ".join(
        f"printf('%.1f%%', avg(CAST({c} AS DOUBLE)) * 100) AS \"{n}\"" for c, n in (
            ("correct", "Execution Accuracy"), ("exact_set_match", "Exact Set Match"),
            ("component_score", "Component Score"), ("select_match", "SELECT Match"), ("from_match", "FROM Match"),
            ("where_match", "WHERE Match"), ("groupby_match", "GROUP BY Match"), ("orderby_match", "ORDER BY Match"))) + """,
  printf('%.1f', avg(execution_time)) AS "Avg Time (s)", printf('%.1f', sum(execution_time)) AS "Total Time (s)"
FROM sc GROUP BY pipeline""",
    "sink_csv_combined": ER + """
SELECT CASE WHEN grouping(db_id) = 0 THEN db_id ELSE 'ALL DATABASES' END AS "Database", replace(pipeline, '_', ' ') AS "Pipeline",
  CAST(count(*) AS VARCHAR) AS "Total Questions", CAST(count(*) FILTER (WHERE correct) AS VARCHAR) AS "Correct",
  printf('%.1f%%', count(*) FILTER (WHERE correct) / count(*) * 100) AS "Accuracy", printf('%.1f', avg(execution_time)) AS "Avg Time (s)"
FROM sc GROUP BY GROUPING SETS ((db_id, pipeline), (pipeline))
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'COMBINED TOTALS', NULL, NULL, NULL, NULL, NULL""",
    "sink_json_detail": ER + """
SELECT sc.db_id, sc.id, sc.question, e.gold_sql, sc.hardness, sc.pipeline, sc.generated_sql,
  round(sc.execution_time, 6) AS execution_time, sc.valid, sc.correct, sc.exact_set_match,
  round(sc.component_score, 6) AS component_score, sc.select_match, sc.from_match, sc.where_match, sc.groupby_match,
  sc.orderby_match, e.error
FROM sc JOIN er e ON e.id = sc.id AND e.pipeline = sc.pipeline""",
    "sink_json_combined": ER + """,
p AS (SELECT pipeline, count(*) AS total_questions, count(*) FILTER (WHERE correct) AS correct_answers,
             round(avg(CAST(correct AS DOUBLE)), 6) AS execution_accuracy, round(sum(execution_time), 4) AS total_time_seconds
      FROM sc GROUP BY pipeline)
SELECT p.*, db_id, count(*) AS db_questions, round(avg(CAST(correct AS DOUBLE)), 6) AS db_accuracy,
  round(avg(execution_time), 6) AS db_avg_time
FROM sc JOIN p USING (pipeline) GROUP BY ALL""",
    "result_csv_export": "SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1",
    "vector_store_save": """
SELECT 'label_' || CAST(label AS VARCHAR) AS db_name, count(*) AS n_docs,
       CAST(min(rn) AS BIGINT) AS first_seq
FROM (SELECT label, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM embeddings) z GROUP BY label""",
    "vector_store_load": f"""
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS seq,
       'label_' || CAST(label AS VARCHAR) AS db_name, 'label ' || CAST(label AS VARCHAR) AS content, {_UNIT_SUM} AS sum_v
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e""",
    "vector_store_roundtrip": f"""
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS seq,
       'label_' || CAST(label AS VARCHAR) AS db_name, {_UNIT_SUM} AS sum_v
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e""",
    "vector_store_add": f"""
WITH n1 AS (SELECT count(*) AS n FROM embeddings), n2 AS (SELECT count(*) AS n FROM benchmark),
s AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY vec_id) - 1 AS seq, 'label_' || CAST(label AS VARCHAR) AS db_name,
         'label ' || CAST(label AS VARCHAR) AS content FROM embeddings
  UNION ALL
  SELECT 'doc_' || CAST(row_number() OVER (ORDER BY item_id) - 1 + (SELECT n FROM n1) AS VARCHAR),
         row_number() OVER (ORDER BY item_id) - 1 + (SELECT n FROM n1), 'bench', text FROM benchmark
  UNION ALL
  SELECT CAST(vec_id AS VARCHAR), row_number() OVER (ORDER BY vec_id) - 1 + (SELECT n FROM n1) + (SELECT n FROM n2),
         'label_again', 'v2' FROM embeddings)
SELECT id, CAST(seq AS BIGINT) AS seq, db_name, md5(content) AS content_md5
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM s) z WHERE rn = 1""",
    "vector_store_get": f"""
WITH n1 AS (SELECT count(*) AS n FROM embeddings), n2 AS (SELECT count(*) AS n FROM benchmark)
SELECT CAST(vec_id AS VARCHAR) AS id,
       CAST(row_number() OVER (ORDER BY vec_id) - 1 + (SELECT n FROM n1) + (SELECT n FROM n2) AS BIGINT) AS seq,
       'v2' AS content, {_UNIT_SUM} AS sum_v
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e
QUALIFY label = 3""",
}

QUERIES = {
    "load_split": _q_load_split,
    "load_split_limit": _q_load_split_limit,
    "load_schema_json": _q_load_schema_json,
    "to_test_cases": _q_to_test_cases,
    "load_test_cases": _q_load_test_cases,
    "sink_csv_detail": _q_detail,
    "sink_csv_detail_roundtrip": _q_detail_roundtrip,
    "sink_csv_summary": _q_summary_csv,
    "sink_csv_combined": _q_combined_csv,
    "sink_json_detail": _q_detail_json,
    "sink_json_combined": _q_combined_json,
    "result_csv_export": _q_result_csv,
    "vector_store_save": _q_store_save,
    "vector_store_load": _q_store_load,
    "vector_store_roundtrip": _q_store_roundtrip,
    "vector_store_add": _q_store_add,
    "vector_store_get": _q_store_get,
}
