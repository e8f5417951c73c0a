"""Query-log and question text analytics over ``query_log``.

Spark side: one projection of Column functions over the derived query log
(no shuffle at all - every function is row-local and JVM-side).
Oracle side: the same rules written as DuckDB SQL over the same derived SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as SC
from ..functions import sqltext as ST
from . import duck as D
from .derived import DATABASES_SQL, QUERY_LOG_SQL, databases, query_log
from .reg import Registry

R = Registry()
c = F.col

QL = f"WITH query_log AS ({QUERY_LOG_SQL})\n"


def _join(arr):
    return F.array_join(arr, ",")


# ------------------------------------------------------------------ C1 - C7
@R.query("extract_sql", QL + f"SELECT qid, {D.extract_sql('response')} AS sql FROM query_log")
def extract_sql(t):
    return query_log(t).select("qid", ST.extract_sql("response").alias("sql"))


@R.query("extract_json", QL + f"SELECT qid, {D.extract_json_text('plan_response')} AS plan_json FROM query_log")
def extract_json(t):
    return query_log(t).select("qid", ST.extract_json_text("plan_response").alias("plan_json"))


@R.query("parse_plan", QL + f"""
SELECT qid,
  CASE WHEN j = '{{}}' THEN {D.question_type('question')}
       ELSE coalesce(json_extract_string(j, '$.query_type'), 'SELECT') END AS query_type,
  CASE WHEN j = '{{}}' THEN '' ELSE coalesce(array_to_string(CAST(json_extract(j, '$.required_tables') AS VARCHAR[]), ','), '') END AS required_tables,
  CASE WHEN j = '{{}}' THEN 2 ELSE coalesce(TRY_CAST(json_extract(j, '$.complexity') AS INTEGER), 0) END AS complexity,
  j = '{{}}' AS fallback
FROM (SELECT qid, question, {D.extract_json_text('plan_response')} AS j FROM query_log) z""")
def parse_plan(t):
    p = ST.parse_plan("plan_response", "question")
    return query_log(t).select("qid", p.alias("p")).select(
        "qid", c("p.query_type").alias("query_type"),
        F.coalesce(_join(c("p.required_tables")), F.lit("")).alias("required_tables"),
        # an absent complexity is reported as 0
        F.coalesce(c("p.complexity"), F.lit(0)).alias("complexity"), c("p.fallback").alias("fallback"))


_CLEANED = QL + f""", ex AS (SELECT qid, question, exec_error, exec_rows, {D.extract_sql('response')} AS sql FROM query_log),
cl AS (SELECT qid, question, exec_error, exec_rows, sql, {D.clean_sql('sql')} AS cleaned FROM ex)
"""


def _cleaned(t):
    return (query_log(t).withColumn("sql", ST.extract_sql("response"))
            .withColumn("cleaned", ST.clean_sql("sql")))


@R.query("clean_sql", _CLEANED + "SELECT qid, cleaned FROM cl")
def clean_sql(t):
    return _cleaned(t).select("qid", "cleaned")


@R.query("validate_sql", _CLEANED + f"""
SELECT qid, e IS NULL AS valid, coalesce(e, '') AS error
FROM (SELECT qid, {D.validate_error('cleaned')} AS e FROM cl) z""")
def validate_sql(t):
    e = ST.validate_error("cleaned")
    return _cleaned(t).select("qid", e.isNull().alias("valid"), F.coalesce(e, F.lit("")).alias("error"))


@R.query("explain_sql", QL + f"SELECT qid, {D.explain_sql('gen_sql')} AS explanation FROM query_log")
def explain_sql(t):
    return query_log(t).select("qid", ST.explain_sql("gen_sql").alias("explanation"))


@R.query("normalize_sql", QL + f"""
SELECT qid, {D.normalize_sql('gen_sql')} AS gen_norm, {D.normalize_sql('gold_sql')} AS gold_norm FROM query_log""")
def normalize_sql(t):
    return query_log(t).select("qid", ST.normalize_sql("gen_sql").alias("gen_norm"),
                               ST.normalize_sql("gold_sql").alias("gold_norm"))


# ------------------------------------------------------------------ C8 - C11
_PARTS = (QL + f", g AS ({D.parts_cte('query_log', 'qid', 'gen_sql', 'g')}),"
          f" o AS ({D.parts_cte('query_log', 'qid', 'gold_sql', 'o')})\n")


def _listed(x: str) -> str:
    return f"'[' || array_to_string({x}, ', ') || ']'"


@R.query("compare_sql", QL + f""", l AS (
SELECT *, list_sort(list_distinct({D.extract_tables('gen_sql')})) AS t1,
  list_sort(list_distinct({D.extract_tables('gold_sql')})) AS t2,
  list_sort(list_distinct({D.columns_of('gen_sql')})) AS c1, list_sort(list_distinct({D.columns_of('gold_sql')})) AS c2
FROM query_log)
SELECT qid, {D.strip('gen_sql')} = {D.strip('gold_sql')} AS exact_match,
  {D.normalize_sql('gen_sql')} = {D.normalize_sql('gold_sql')} AS normalized_match,
  {D.statement_kind('gen_sql')} = {D.statement_kind('gold_sql')} AND t1 = t2 AS semantic_similar,
  {D.normalize_sql('gen_sql')} AS sql1_normalized, {D.normalize_sql('gold_sql')} AS sql2_normalized,
  concat_ws(' | ', CASE WHEN t1 <> t2 THEN 'Tables: ' || {_listed('t1')} || ' vs ' || {_listed('t2')} END,
    CASE WHEN c1 <> c2 THEN 'Columns: ' || {_listed('c1')} || ' vs ' || {_listed('c2')} END) AS differences FROM l""")
def compare_sql(t):
    r = ST.compare_sql_df(query_log(t).select("qid", "gen_sql", "gold_sql"), "gen_sql", "gold_sql")
    return r.select("qid", *ST.COMPARE_FIELDS).withColumn("differences", F.concat_ws(" | ", "differences"))


@R.query("extract_tables", QL + f"""
SELECT qid, array_to_string({D.extract_tables('gold_sql')}, ',') AS tables FROM query_log""")
def extract_tables(t):
    return query_log(t).select("qid", _join(ST.extract_tables("gold_sql")).alias("tables"))


@R.query("extract_columns", QL + f"SELECT qid, array_to_string({D.columns_of('gold_sql')}, ',') AS columns FROM query_log")
def extract_columns(t):
    return ST.with_columns_of(query_log(t).select("qid", "gold_sql"), "gold_sql", "c").select(
        "qid", _join(c("c")).alias("columns"))


@R.query("relevant_tables", QL + f""", databases AS ({DATABASES_SQL}),
hit AS (SELECT qid, lower("table") AS name FROM query_log JOIN databases USING (db_id) WHERE regexp_matches(lower(gold_sql),
  '\\bfrom\\s+' || lower("table") || '\\b|\\bjoin\\s+' || lower("table") || '\\b|\\b' || lower("table") || '\\s+as\\b|\\b' || lower("table") || '\\.'))
SELECT qid, coalesce(names, '') AS relevant_tables FROM query_log LEFT JOIN (
  SELECT qid, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hit GROUP BY qid) h USING (qid)""")
def relevant_tables(t):
    """C11: the tables of the question's own database that its gold SQL names."""
    found = ST.relevant_tables_of(query_log(t).select("qid", "db_id", "gold_sql"), "gold_sql", databases(t))
    return found.select("qid", _join(c("relevant_tables")).alias("relevant_tables"))


# ------------------------------------------------------------------ C13 - C19
@R.query("query_type", QL + f"SELECT qid, {D.query_type('gen_sql')} AS query_type FROM query_log")
def query_type(t):
    return query_log(t).select("qid", ST.query_type("gen_sql").alias("query_type"))


@R.query("read_only_guard", _CLEANED + f"""
SELECT qid, e IS NULL AS allowed, coalesce(e, '') AS error
FROM (SELECT qid, {D.guard_error('cleaned')} AS e FROM cl) z""")
def read_only_guard(t):
    g = ST.read_only_guard("cleaned")
    return _cleaned(t).select("qid", g["allowed"].alias("allowed"),
                              F.coalesce(g["error"], F.lit("")).alias("error"))


@R.query("question_type", QL + f"SELECT qid, {D.question_type('question')} AS question_type FROM query_log")
def question_type(t):
    return query_log(t).select("qid", ST.question_type("question").alias("question_type"))


@R.query("question_complexity", QL + f"""
SELECT qid, CAST({D.question_complexity('question')} AS INTEGER) AS complexity FROM query_log""")
def question_complexity(t):
    return query_log(t).select("qid", ST.question_complexity("question").cast("int").alias("complexity"))


@R.query("hardness", QL + f"SELECT qid, {D.hardness('gold_sql')} AS hardness FROM query_log")
def hardness(t):
    return query_log(t).select("qid", ST.hardness("gold_sql").alias("hardness"))


@R.query("easy_filter", QL + f"SELECT qid FROM query_log WHERE {D.easy_keep('gold_sql')}")
def easy_filter(t):
    return query_log(t).filter(ST.easy_filter("gold_sql")).select("qid")


_CM_SQL = _PARTS + f"""
, cm AS (
SELECT q.qid,
  CASE WHEN ok THEN g.g_aggs = o.o_aggs ELSE FALSE END AS select_match,
  CASE WHEN ok THEN g.g_tables = o.o_tables ELSE FALSE END AS from_match,
  CASE WHEN ok THEN (CASE WHEN g.g_has_where AND o.o_has_where THEN g.g_where_cols = o.o_where_cols
                          ELSE NOT g.g_has_where AND NOT o.o_has_where END) ELSE FALSE END AS where_match,
  CASE WHEN ok THEN (CASE WHEN g.g_has_group AND o.o_has_group THEN g.g_group_cols = o.o_group_cols
                          ELSE NOT g.g_has_group AND NOT o.o_has_group END) ELSE FALSE END AS groupby_match,
  CASE WHEN ok THEN (CASE WHEN g.g_has_order AND o.o_has_order THEN g.g_order_cols = o.o_order_cols
                          ELSE NOT g.g_has_order AND NOT o.o_has_order END) ELSE FALSE END AS orderby_match
FROM (SELECT qid, {D.parse_ok('gen_sql')} AND {D.parse_ok('gold_sql')} AS ok FROM query_log) q
JOIN g ON g.qid = q.qid JOIN o ON o.qid = q.qid)
"""


@R.query("component_match", _CM_SQL + """
SELECT qid, select_match, from_match, where_match, groupby_match, orderby_match,
  round((CAST(select_match AS INTEGER) + CAST(from_match AS INTEGER) + CAST(where_match AS INTEGER)
        + CAST(groupby_match AS INTEGER) + CAST(orderby_match AS INTEGER)) / 5.0, 6) AS component_score
FROM cm""")
def component_match(t):
    m = ST.component_match_df(query_log(t).select("qid", "gen_sql", "gold_sql"), "gen_sql", "gold_sql")
    return m.select("qid", "select_match", "from_match", "where_match", "groupby_match", "orderby_match",
                    F.round("component_score", 6).alias("component_score"))


# ------------------------------------------------------------------ C20 - C25
_OK = "(exec_error IS NULL)"


@R.query("score_syntax", QL + f"SELECT qid, round({D.score_syntax('gen_sql')}, 6) AS syntax_score FROM query_log")
def score_syntax(t):
    return query_log(t).select("qid", F.round(SC.score_syntax("gen_sql"), 6).alias("syntax_score"))


@R.query("score_execution", QL + f"""
SELECT qid, {D.score_execution(_OK, 'exec_error')} AS execution_score FROM query_log""")
def score_execution(t):
    return query_log(t).select("qid", SC.score_execution(c("exec_error").isNull(), "exec_error")
                               .alias("execution_score"))


@R.query("score_semantic", QL + f"""
SELECT qid, round({D.score_semantic('question', 'gen_sql', _OK, 'exec_rows')}, 6) AS semantic_score FROM query_log""")
def score_semantic(t):
    s = SC.score_semantic("question", "gen_sql", c("exec_error").isNull(), "exec_rows")
    return query_log(t).select("qid", F.round(s, 6).alias("semantic_score"))


@R.query("score_efficiency", QL + f"""
SELECT qid, round({D.score_efficiency('gen_sql')}, 6) AS efficiency_score FROM query_log""")
def score_efficiency(t):
    return query_log(t).select("qid", F.round(SC.score_efficiency("gen_sql"), 6).alias("efficiency_score"))


@R.query("score_overall", QL + f"""
SELECT qid, round(0.15 * s1 + 0.35 * s2 + 0.35 * s3 + 0.15 * s4, 6) AS overall_score
FROM (SELECT qid, {D.score_syntax('gen_sql')} AS s1, {D.score_execution(_OK, 'exec_error')} AS s2,
             {D.score_semantic('question', 'gen_sql', _OK, 'exec_rows')} AS s3,
             {D.score_efficiency('gen_sql')} AS s4 FROM query_log) z""")
def score_overall(t):
    ok = c("exec_error").isNull()
    s = SC.score_overall(SC.score_syntax("gen_sql"), SC.score_execution(ok, "exec_error"),
                         SC.score_semantic("question", "gen_sql", ok, "exec_rows"),
                         SC.score_efficiency("gen_sql"))
    return query_log(t).select("qid", F.round(s, 6).alias("overall_score"))


@R.query("score_final", _CM_SQL + f"""
SELECT q.qid, round(0.5 * CAST(q.exec_correct AS DOUBLE)
  + 0.3 * (CAST(select_match AS INTEGER) + CAST(from_match AS INTEGER) + CAST(where_match AS INTEGER)
           + CAST(groupby_match AS INTEGER) + CAST(orderby_match AS INTEGER)) / 5.0
  + 0.2 * CAST(({D.statement_kind('q.gen_sql')} = {D.statement_kind('q.gold_sql')})
    AND list_sort(list_distinct({D.extract_tables('q.gen_sql')})) = list_sort(list_distinct({D.extract_tables('q.gold_sql')}))
    AS DOUBLE), 6) AS final_score
FROM query_log q JOIN cm ON cm.qid = q.qid""")
def score_final(t):
    m = ST.component_match_df(query_log(t).select("qid", "gen_sql", "gold_sql", "exec_correct"), "gen_sql", "gold_sql")
    s = SC.score_final(c("exec_correct"), c("component_score"), ST.semantic_similar("gen_sql", "gold_sql"))
    return m.select("qid", F.round(s, 6).alias("final_score"))


# ------------------------------------------------------------------ C26
@R.query("search_query_text", QL + f"""
SELECT qid, concat_ws(' ', question,
  CASE WHEN len(tb) > 0 THEN array_to_string(tb, ' ') END,
  CASE WHEN len(cl) > 0 THEN array_to_string(cl, ' ') END) AS search_text
FROM (SELECT qid, question,
        CASE WHEN j = '{{}}' THEN [] ELSE CAST(json_extract(j, '$.required_tables') AS VARCHAR[]) END AS tb,
        CASE WHEN j = '{{}}' THEN [] ELSE CAST(json_extract(j, '$.required_columns') AS VARCHAR[]) END AS cl
      FROM (SELECT qid, question, {D.extract_json_text('plan_response')} AS j FROM query_log) z0) z""")
def search_query_text(t):
    p = ST.parse_plan("plan_response", "question")
    return query_log(t).select(
        "qid", F.concat_ws(" ", c("question"), p["required_tables"], p["required_columns"]).alias("search_text"))


QUERIES = R.queries
ORACLES = R.oracles


# ------------------------------------------------------------------ C27
# The single-agent prompt template.
PROMPT_HEAD = "You are a SQL expert. Generate a SQLite query to answer the question.\n\nDatabase Schema:\n"
PROMPT_TAIL = ("\n\nRequirements:\n1. Output ONLY the SQL query, nothing else\n2. Use valid SQLite syntax\n"
               "3. End with semicolon\n4. Use appropriate JOINs if needed\n\nSQL:")


def prompt_text(question, schema) -> F.Column:
    """The generation prompt of one question over its database schema text."""
    return F.concat(F.lit(PROMPT_HEAD), schema, F.lit("\n\nQuestion: "), question, F.lit(PROMPT_TAIL))


def _q_prompt_text(t):
    from ..sources.catalog import schema_columns, schema_text
    st = F.broadcast(schema_text(schema_columns(t)))  # one row per database
    p = query_log(t).crossJoin(st).select("qid", prompt_text(c("question"), c("schema_text")).alias("p"))
    return p.select("qid", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("prompt_md5"))


def _prompt_oracle():
    from ..sources.catalog import COLS_CTE
    head = PROMPT_HEAD.replace("\n", "' || chr(10) || '")
    tail = PROMPT_TAIL.replace("\n", "' || chr(10) || '")
    p = f"'{head}' || st.schema_text || chr(10) || chr(10) || 'Question: ' || q.question || '{tail}'"
    return (f"WITH query_log AS ({QUERY_LOG_SQL}),\n" + COLS_CTE +
            f"\nSELECT q.qid, CAST(length({p}) AS BIGINT) AS n_chars, md5({p}) AS prompt_md5 FROM query_log q CROSS JOIN st")


R.query("prompt_text", _prompt_oracle())(_q_prompt_text)


@R.query("score_feedback", QL + f"""
SELECT qid, {D.feedback('gen_sql', 'question', _OK, 'exec_error', 'exec_rows')} AS feedback FROM query_log""")
def score_feedback(t):
    """C24 feedback list, one ' | '-joined text per question."""
    f = SC.feedback("gen_sql", "question", c("exec_error").isNull(), "exec_error", "exec_rows")
    return query_log(t).select("qid", f.alias("feedback"))
QUERIES = R.queries
ORACLES = R.oracles
