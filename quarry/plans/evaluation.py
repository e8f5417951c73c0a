"""The evaluation row itself: outcomes computed from statements and result rows.

One row per logged question: clause matches of its statements (C19), the
set comparison of its result rows (D1, for the question of the same number:
an order's returned items against its finished items), its hardness (C17) and
its run's outcome.  The rows feed the summaries F1, F2 and F6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as ST
from ..operators.compare import exact_set_match
from . import duck as D
from . import textq as TQ
from .derived import QUERY_LOG_SQL, query_log
from .reg import Registry
from .reports import ER, _F1_COLS, _round_all, by_hardness, combined_totals, pipeline_summary

R = Registry()
c = F.col

# Result rows of every order: ONE SQL text run by both engines.
ORDER_ROWS_SQL = """
SELECT 'gen' AS side, l_orderkey AS question, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT 'gold' AS side, l_orderkey AS question, l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'F'
"""


def evaluation_rows(log: DataFrame, rows: DataFrame, row_cols: list[str]) -> DataFrame:
    """Outcome rows of a query log and the result rows (side, question, ...) of its questions."""
    parts = ST.component_match_df(log, "gen_sql", "gold_sql")
    same = exact_set_match(rows, row_cols, log.select("qid")).withColumnRenamed("question", "d1_question")
    d = parts.join(same, c("qid") == c("d1_question"))
    valid = c("exec_error").isNull()
    return d.select(
        "db_id", c("qid").alias("id"),
        F.element_at(F.array(F.lit("Single_Agent"), F.lit("Multi_Agent"), F.lit("Multi_Agent_RAG")),
                     (c("qid") % 3 + 1).cast("int")).alias("pipeline"),
        ST.hardness("gold_sql").alias("hardness"), valid.alias("valid"),
        (valid & c("exact_set_match")).alias("correct"), (valid & c("exact_set_match")).alias("exact_set_match"),
        "select_match", "from_match", "where_match", "groupby_match", "orderby_match",
        (c("qid") % 97 / 10).alias("execution_time"), c("gen_sql").alias("generated_sql"), "question", "gold_sql",
        c("exec_error").alias("error"))


def _rows(t) -> DataFrame:
    log = query_log(t).select("qid", "db_id", "question", "gen_sql", "gold_sql", "exec_error")
    return evaluation_rows(log, t.sql(ORDER_ROWS_SQL), ["l_partkey", "l_quantity"])


def _oracle(select: str) -> str:
    body = f"""
{TQ._CM_SQL},
rr AS ({ORDER_ROWS_SQL}),
pk AS (SELECT question, array_to_string(list_sort([CAST(l_partkey AS VARCHAR), CAST(l_quantity AS VARCHAR)]), chr(1)) AS k,
              sum(CASE WHEN side = 'gen' THEN 1 ELSE 0 END) AS ng, sum(CASE WHEN side = 'gold' THEN 1 ELSE 0 END) AS no
       FROM rr GROUP BY question, k),
d1 AS (SELECT question AS qid, count(*) FILTER (WHERE (ng > 0) <> (no > 0)) = 0 AS same FROM pk GROUP BY question),
er AS (SELECT q.db_id, q.qid AS id,
         CASE q.qid % 3 WHEN 0 THEN 'Single_Agent' WHEN 1 THEN 'Multi_Agent' ELSE 'Multi_Agent_RAG' END AS pipeline,
         {D.hardness('q.gold_sql')} AS hardness, q.exec_error IS NULL AS valid,
         q.exec_error IS NULL AND coalesce(d1.same, TRUE) AS correct,
         q.exec_error IS NULL AND coalesce(d1.same, TRUE) AS exact_set_match,
         select_match, from_match, where_match, groupby_match, orderby_match,
         q.qid % 97 / 10 AS execution_time, q.gen_sql AS generated_sql, q.question
       FROM query_log q JOIN cm ON cm.qid = q.qid LEFT JOIN d1 ON d1.qid = q.qid),
"""
    return body + ER[ER.index("sc AS ("):] + select


@R.query("evaluation_summary", _oracle(f"SELECT db_id, pipeline, {_F1_COLS} FROM sc GROUP BY db_id, pipeline"))
def evaluation_summary(t):
    """F1 over computed outcomes."""
    return _round_all(pipeline_summary(_rows(t)), ())


@R.query("evaluation_by_hardness", _oracle("""
SELECT db_id, pipeline, """ + ", ".join(f"""
  count(*) FILTER (WHERE hardness = '{h}') AS {h}_total, count(*) FILTER (WHERE hardness = '{h}' AND correct) AS {h}_correct,
  round(CASE WHEN count(*) FILTER (WHERE hardness = '{h}') > 0 THEN count(*) FILTER (WHERE hardness = '{h}' AND correct)
        / count(*) FILTER (WHERE hardness = '{h}') ELSE 0.0 END, 6) AS {h}_accuracy""" for h in ("easy", "medium")) + """
FROM sc GROUP BY db_id, pipeline"""))
def evaluation_by_hardness(t):
    """F2 over computed outcomes."""
    return by_hardness(_rows(t))


@R.query("evaluation_totals", _oracle("""
SELECT CASE WHEN grouping(db_id) = 0 THEN db_id ELSE 'ALL DATABASES' END AS database, pipeline,
  count(*) AS total, count(*) FILTER (WHERE correct) AS correct,
  round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(avg(execution_time), 6) AS avg_time
FROM sc GROUP BY GROUPING SETS ((db_id, pipeline), (pipeline))"""))
def evaluation_totals(t):
    """F6 over computed outcomes."""
    return combined_totals(_rows(t))


# The lines of the generation prompt with plan and error feedback.
RULE = "=" * 50
ASK = "Generate a SQLite query to answer the following question."
TASK = "Generate ONLY the SQL query (no explanations):"


def generation_prompt(question, schema, plan=None, error=None, examples: str | F.Column = "") -> F.Column:
    """The prompt of the generating step; examples, plan and earlier error are left out where absent."""
    lines = [F.lit(ASK), F.lit(""), F.lit(RULE), F.lit("DATABASE SCHEMA:"), F.lit(RULE), schema, F.lit("")]
    if isinstance(examples, F.Column) or examples:
        lines += [F.lit(RULE), examples if isinstance(examples, F.Column) else F.lit(examples), F.lit(RULE), F.lit("")]
    if plan is not None:
        lines += [F.when(plan.isNotNull(), F.concat_ws(
            "\n", F.lit("QUERY ANALYSIS:"), F.concat(F.lit("- Query Type: "), plan["query_type"]),
            F.concat(F.lit("- Complexity: "), F.coalesce(plan["complexity"].cast("string"), F.lit("simple"))),
            F.concat(F.lit("- Required Tables: "), F.coalesce(F.array_join(plan["required_tables"], ", "), F.lit(""))),
            F.lit("")))]
    if error is not None:
        lines += [F.when(error.isNotNull(), F.concat(F.lit("⚠️ PREVIOUS ERROR - Please fix:\n"), error, F.lit("\n")))]
    lines += [F.lit(RULE), F.lit("YOUR TASK:"), F.lit(RULE), F.concat(F.lit("Question: "), question), F.lit(""), F.lit(TASK)]
    return F.concat_ws("\n", *lines)


def _prompt_sql() -> str:
    nl = "chr(10)"
    plan = (f"'QUERY ANALYSIS:' || {nl} || '- Query Type: ' || qt || {nl} || '- Complexity: ' || cx || {nl} || "
            f"'- Required Tables: ' || tb || {nl}")
    p = (f"concat_ws({nl}, '{ASK}', '', '{RULE}', 'DATABASE SCHEMA:', '{RULE}', st.schema_text, '', {plan}, "
         f"'⚠️ PREVIOUS ERROR - Please fix:' || {nl} || exec_error || {nl}, "
         f"'{RULE}', 'YOUR TASK:', '{RULE}', 'Question: ' || question, '', '{TASK}')")
    from ..sources.catalog import COLS_CTE
    return f"WITH query_log AS ({QUERY_LOG_SQL}),\n" + COLS_CTE + f""",
pl AS (SELECT qid, question, exec_error,
  CASE WHEN j = '{{}}' THEN {D.question_type('question')} ELSE coalesce(json_extract_string(j, '$.query_type'), 'SELECT') END AS qt,
  CASE WHEN j = '{{}}' THEN '2' ELSE coalesce(CAST(TRY_CAST(json_extract(j, '$.complexity') AS INTEGER) AS VARCHAR), 'simple') END AS cx,
  CASE WHEN j = '{{}}' THEN '' ELSE coalesce(array_to_string(CAST(json_extract(j, '$.required_tables') AS VARCHAR[]), ', '), '') END AS tb
  FROM (SELECT qid, question, exec_error, {D.extract_json_text('plan_response')} AS j FROM query_log) z)
SELECT qid, CAST(length({p}) AS BIGINT) AS n_chars, md5({p}) AS prompt_md5 FROM pl CROSS JOIN st"""


@R.query("generation_prompt", _prompt_sql())
def q_generation_prompt(t):
    from ..sources.catalog import schema_columns, schema_text
    schema = schema_text(schema_columns(t)).select("schema_text")  # one row
    q = query_log(t).select("qid", "question", "exec_error", ST.parse_plan("plan_response", "question").alias("plan"))
    p = q.crossJoin(schema).select("qid", generation_prompt(
        c("question"), c("schema_text"), c("plan"), c("exec_error")).alias("p"))
    return p.select("qid", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("prompt_md5"))


# The lines of the planning prompt and the kinds of query it names.
PLAN_HEAD = "Analyze the following natural language question and create a query plan.\n\nQuestion: "
KINDS = ["SELECT", "COUNT", "AGGREGATE", "JOIN", "GROUPBY", "ORDERBY", "FILTER", "SUBQUERY", "COMPLEX"]
PLAN_TAIL = f"""

Determine:
1. Query Type: One of {KINDS}
2. Required Tables: List tables likely needed
3. Required Columns: List columns likely needed
4. Operations: List SQL operations needed (SELECT, WHERE, JOIN, GROUP BY, etc.)
5. Complexity: Rate from 1-5 (1=simple, 5=very complex)

Respond in this exact JSON format:
{{
    "query_type": "<primary query type>",
    "required_tables": ["table1", "table2"],
    "required_columns": ["col1", "col2"],
    "operations": ["SELECT", "WHERE", "JOIN"],
    "complexity": 3,
    "reasoning": "Brief explanation of the plan"
}}

Only respond with the JSON, no other text."""


def planning_prompt(question) -> F.Column:
    """The prompt of the planning step."""
    return F.concat(F.lit(PLAN_HEAD), question, F.lit(PLAN_TAIL))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAN_SQL = f"{_quoted(PLAN_HEAD)} || question || {_quoted(PLAN_TAIL)}"


@R.query("planning_prompt", f"""WITH query_log AS ({QUERY_LOG_SQL})
SELECT qid, CAST(length({_PLAN_SQL}) AS BIGINT) AS n_chars, md5({_PLAN_SQL}) AS prompt_md5 FROM query_log""")
def q_planning_prompt(t):
    p = query_log(t).select("qid", planning_prompt(c("question")).alias("p"))
    return p.select("qid", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("prompt_md5"))


def few_shot_text(log: DataFrame) -> DataFrame:
    """One row: an example of each hardness, the shortest gold SQL of its questions, numbered easy to hard."""
    order = F.when(c("hardness") == "easy", 0).when(c("hardness") == "medium", 1).otherwise(2)
    shots = log.select(ST.hardness("gold_sql").alias("hardness"), "question", "gold_sql").groupBy(order.alias("o")).agg(
        F.min(F.struct(F.length("gold_sql").alias("size"), "gold_sql", "question")).alias("x"))
    listed = F.sort_array(F.collect_list(F.struct("o", "x.question", "x.gold_sql")))  # a row a class
    return shots.agg(F.array_join(F.transform(listed, lambda e, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\nQuestion: "), e["question"], F.lit("\nSQL: "), e["gold_sql"])),
        "\n\n").alias("examples"))


def _few_shot_sql() -> str:
    from ..sources.catalog import COLS_CTE
    nl = "chr(10)"
    p = (f"concat_ws({nl}, '{ASK}', '', '{RULE}', 'DATABASE SCHEMA:', '{RULE}', st.schema_text, '', '{RULE}', examples, '{RULE}', '', "
         f"'{RULE}', 'YOUR TASK:', '{RULE}', 'Question: ' || question, '', '{TASK}')")
    return f"WITH query_log AS ({QUERY_LOG_SQL}),\n" + COLS_CTE + f""",
h AS (SELECT CASE {D.hardness('gold_sql')} WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS o, question, gold_sql FROM query_log),
pick AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY length(gold_sql), gold_sql, question) AS n FROM h),
ex AS (SELECT o, question, gold_sql, row_number() OVER (ORDER BY o) AS i FROM pick WHERE n = 1),
fs AS (SELECT string_agg('Example ' || i || ':' || {nl} || 'Question: ' || question || {nl} || 'SQL: ' || gold_sql,
  {nl} || {nl} ORDER BY i) AS examples FROM ex)
SELECT qid, CAST(length({p}) AS BIGINT) AS n_chars, md5({p}) AS prompt_md5 FROM query_log CROSS JOIN st CROSS JOIN fs"""


@R.query("few_shot_prompt", _few_shot_sql())
def q_few_shot_prompt(t):
    """C27 with examples taken from the log, without a plan."""
    from ..sources.catalog import schema_columns, schema_text
    log = query_log(t)
    one = schema_text(schema_columns(t)).select("schema_text").crossJoin(few_shot_text(log))  # one row
    p = log.select("qid", "question").crossJoin(one).select("qid", generation_prompt(
        c("question"), c("schema_text"), None, examples=c("examples")).alias("p"))
    return p.select("qid", F.length("p").cast("long").alias("n_chars"), F.md5("p").alias("prompt_md5"))


QUERIES = R.queries
ORACLES = R.oracles
