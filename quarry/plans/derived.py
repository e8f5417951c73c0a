"""Derived input tables built from the fixture tables.

Each derived table is ONE SQL text that Spark SQL and DuckDB both run
unchanged, so both engines see identical inputs; the operator under test is
then written separately on each side (DataFrame API vs oracle SQL).

* ``query_log``  - one benchmark question per order: question text, gold SQL,
  generated SQL, raw model response and a raw plan response.  The template is
  picked by ``o_orderkey % 16`` and keys from the row are spliced in.
* ``eval_results`` - one row per (question, pipeline) outcome.
* ``result_rows`` - generated / gold result rows per question from lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import Tables

# The sixteen question templates of the synthetic query log.
# Each entry is (question, gold SQL, generated SQL); {k} is o_custkey,
# {x} is o_orderkey % 100 (both spliced in as text).
TEMPLATES = [
    ("How many orders does customer {k} have?",
     "SELECT count(*) FROM orders WHERE o_custkey = {k}",
     "SELECT COUNT(*) FROM orders WHERE o_custkey = {k};"),
    ("What is the average total price of orders for customer {k}?",
     "SELECT avg(o_totalprice) FROM orders WHERE o_custkey = {k}",
     "select avg(o_totalprice)  from main.orders\nwhere o_custkey = {k}"),
    ("Show the number of orders for each priority",
     "SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, COUNT(o_orderkey) FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority"),
    ("List the names of customers along with their nation",
     "SELECT c.c_name, n.n_name FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey",
     "SELECT c_name, n_name FROM \"customer\" JOIN `nation` ON c_nationkey = n_nationkey WHERE c_custkey = {k}"),
    ("Which customers have orders with total price above {x}000?",
     "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > {x}000)",
     "SELECT DISTINCT c.c_name FROM customer c, orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_totalprice > {x}000;"),
    ("What are the top 5 most expensive parts?",
     "SELECT p_name FROM part ORDER BY p_retailprice DESC LIMIT 5",
     "SELECT * FROM part ORDER BY p_retailprice DESC LIMIT 5;"),
    ("Find the maximum account balance per market segment",
     "SELECT c_mktsegment, max(c_acctbal) FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment, MAX(c_acctbal) AS max_bal FROM customer GROUP BY c_mktsegment HAVING count(*) > {x}"),
    ("List nations that have suppliers or customers with negative balance",
     "SELECT n_name FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal < 0 UNION "
     "SELECT n_name FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal < 0",
     "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)"),
    ("How many line items were returned for order {k}?",
     "SELECT count(*) FROM lineitem WHERE l_orderkey = {k} AND l_returnflag = 'R'",
     "SELECT COUNT(*) FROM lineitem WHERE l_orderkey = {k} AND l_returnflag = 'R"),
    ("Show the total quantity sold of each part brand sorted by quantity",
     "SELECT p.p_brand, sum(l.l_quantity) FROM lineitem AS l JOIN part AS p ON l.l_partkey = p.p_partkey "
     "GROUP BY p.p_brand ORDER BY sum(l.l_quantity) DESC",
     "SELECT p_brand, SUM(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey "
     "JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand ORDER BY qty DESC;"),
    ("Which orders were placed by customers from nation {x}?",
     "SELECT o.o_orderkey FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey "
     "JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey = {x}",
     "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = {x})"),
    ("Count the number of distinct customers who placed urgent orders",
     "SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'",
     "SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT';"),
    ("What is the minimum supplier balance?",
     "SELECT min(s_acctbal) FROM supplier",
     "SELECT MIN(s_acctbal) FROM supplier WHERE s_suppkey > ({k}"),
    ("Delete the orders of customer {k}",
     "DELETE FROM orders WHERE o_custkey = {k}",
     "DELETE FROM orders"),
    ("Show customers with their order count, ranked",
     "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
     "SELECT c_name, n FROM customer JOIN t ON c_custkey = o_custkey ORDER BY n DESC",
     "SELECT c_name, COUNT(*) AS n FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey "
     "GROUP BY c_name ORDER BY n DESC LIMIT 10;"),
    ("List parts whose size is between 10 and {x}",
     "SELECT p_name FROM part WHERE p_size BETWEEN 10 AND {x} INTERSECT "
     "SELECT p_name FROM part WHERE p_retailprice > 1000",
     ""),
]


def _sql_text(template: str) -> str:
    """A template as an SQL string expression that both engines evaluate alike."""
    parts = []
    buf = ""
    i = 0
    while i < len(template):
        if template.startswith("{k}", i) or template.startswith("{x}", i):
            if buf:
                parts.append(buf)
                buf = ""
            parts.append(template[i:i + 3])
            i += 3
        else:
            buf += template[i]
            i += 1
    if buf:
        parts.append(buf)
    out = []
    for p in parts:
        if p == "{k}":
            out.append("CAST(o_custkey AS STRING)")
        elif p == "{x}":
            out.append("CAST(o_orderkey % 100 AS STRING)")
        else:
            lines = p.split("\n")
            lits = ["'" + ln.replace("'", "''") + "'" for ln in lines]
            out.append(" || chr(10) || ".join(lits))
    return "(" + " || ".join(out) + ")" if out else "''"


def _case(idx: int) -> str:
    arms = "\n".join(f"    WHEN {i} THEN {_sql_text(t[idx])}" for i, t in enumerate(TEMPLATES))
    return f"CASE o_orderkey % 16\n{arms}\n  END"


def _query_log_sql() -> str:
    gen = "gen_sql"
    return f"""
SELECT qid, db_id, question, gold_sql, gen_sql,
  CASE qid % 3
    WHEN 0 THEN 'Here is the query:' || chr(10) || '```sql' || chr(10) || {gen} || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN 'The answer is ' || {gen} || ' which should work.'
    ELSE '```' || chr(10) || {gen} || chr(10) || '```'
  END AS response,
  CASE qid % 4
    WHEN 0 THEN 'Plan:' || chr(10) || '```json' || chr(10) || '{{"query_type": "COUNT", "required_tables": ["orders", "customer"], "required_columns": ["o_custkey"], "complexity": ' || CAST(qid % 5 + 1 AS STRING) || '}}' || chr(10) || '```'
    WHEN 1 THEN 'I think {{"query_type": "JOIN", "required_tables": ["lineitem"], "complexity": 3}} is right'
    WHEN 2 THEN 'No plan could be made.'
    ELSE '```' || chr(10) || '{{"required_tables": ["part", "supplier"], "operations": ["filter"]}}' || chr(10) || '```'
  END AS plan_response,
  CASE qid % 7
    WHEN 1 THEN 'no such table: ordrs'
    WHEN 2 THEN 'no such column: o_price'
    WHEN 3 THEN 'near "FORM": syntax error'
    WHEN 4 THEN '[TABLE_OR_VIEW_NOT_FOUND] The table or view `ordrs` cannot be found.'
    ELSE NULL
  END AS exec_error,
  CASE WHEN qid % 7 IN (1, 2, 3, 4) THEN 0 ELSE qid % 5 END AS exec_rows,
  qid % 7 NOT IN (1, 2, 3, 4) AND qid % 5 > 1 AS exec_correct
FROM (
  SELECT o_orderkey AS qid, o_orderpriority AS db_id,
  {_case(0)} AS question,
  {_case(1)} AS gold_sql,
  {_case(2)} AS gen_sql
  FROM orders
) base
"""


QUERY_LOG_SQL = _query_log_sql()

# Pipeline names of the evaluation.
PIPELINES = ("Single_Agent", "Multi_Agent", "Multi_Agent_RAG")

EVAL_RESULTS_SQL = """
SELECT
  CASE (o.o_orderkey - o.o_orderkey % 3) % 5
    WHEN 0 THEN 'car_1' WHEN 1 THEN 'concert_singer' WHEN 2 THEN 'dog_kennels'
    WHEN 3 THEN 'student_transcripts_tracking' ELSE 'world_1' END AS db_id,
  o.o_orderkey - o.o_orderkey % 3 AS id,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Single_Agent' WHEN 1 THEN 'Multi_Agent' ELSE 'Multi_Agent_RAG' END AS pipeline,
  CASE WHEN (o.o_orderkey - o.o_orderkey % 3) % 2 = 0 THEN 'easy' ELSE 'medium' END AS hardness,
  (o.o_orderstatus = 'F' OR c.c_acctbal > 0) AS valid,
  o.o_orderstatus = 'F' AS correct,
  o.o_orderstatus = 'F' AS exact_set_match,
  o.o_custkey % 2 = 1 AS select_match,
  o.o_custkey % 4 >= 2 AS from_match,
  o.o_custkey % 8 >= 4 AS where_match,
  o.o_custkey % 16 >= 8 AS groupby_match,
  o.o_custkey % 32 >= 16 AS orderby_match,
  o.o_totalprice / 10000 AS execution_time,
  CASE WHEN o.o_orderkey % 97 = 0 THEN '' ELSE 'SELECT ' || CAST(o.o_custkey AS STRING) END AS generated_sql,
  'Question ' || CAST(o.o_orderkey - o.o_orderkey % 3 AS STRING) AS question,
  'SELECT name FROM t WHERE id = ' || CAST(o.o_orderkey - o.o_orderkey % 3 AS STRING) AS gold_sql,
  CASE WHEN o.o_orderstatus = 'F' OR c.c_acctbal > 0 THEN NULL ELSE 'no such column: t.' || CAST(o.o_custkey AS STRING) END AS error
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

# Generated rows: returned line items; gold rows: finished line items;
# question = supplier; row = (l_partkey, l_quantity); ord = row order.
RESULT_ROWS_SQL = """
SELECT 'gen' AS side, l_suppkey AS question, l_partkey, l_quantity, l_orderkey, l_linenumber
FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT 'gold' AS side, l_suppkey AS question, l_partkey, l_quantity, l_orderkey, l_linenumber
FROM lineitem WHERE l_linestatus = 'F'
"""


# Results of several shapes: each question's statements name, order and type their own columns.
# 0 same columns, other rows; 1 other names; 2 a column missing; 3 double and integer;
# 4 text and number; 5 other order; 6 decimal and integer.
RESULT_SHAPES_SQL = """
SELECT 'gen' AS side, l_suppkey AS question, l_suppkey % 7 AS shape, l_partkey, l_quantity, l_discount, l_orderkey, l_linenumber
FROM lineitem WHERE l_returnflag = 'R'
UNION ALL
SELECT 'gold' AS side, l_suppkey AS question, l_suppkey % 7 AS shape, l_partkey, l_quantity, l_discount, l_orderkey, l_linenumber
FROM lineitem WHERE CASE WHEN l_suppkey % 7 = 0 THEN l_linestatus = 'F' ELSE l_returnflag = 'R' END
"""


# Catalog of several databases: each has its own part of the tables.
DATABASES_SQL = """
SELECT db_id, name AS "table" FROM (SELECT DISTINCT o_orderpriority AS db_id FROM orders) d CROSS JOIN (VALUES
  ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'),
  ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) v(name)
WHERE (length(name) + CAST(substr(db_id, 1, 1) AS INT)) % 3 <> 0
"""


def databases(t: Tables) -> DataFrame:
    """(db_id, table) of every database of the log."""
    return t.sql(DATABASES_SQL.replace('"', "`"))


def query_log(t: Tables) -> DataFrame:
    # Text functions are CPU-heavy: give them every core even when the
    # source is one file split (no-op on a many-split input).  The orders are
    # dealt, before their texts are made.
    from ..operators.sizing import spread
    spread(t.orders).createOrReplaceTempView("dealt_orders")
    return t.spark.sql(QUERY_LOG_SQL.replace("FROM orders\n", "FROM dealt_orders\n"))


def eval_results(t: Tables) -> DataFrame:
    return t.sql(EVAL_RESULTS_SQL)


def result_rows(t: Tables) -> DataFrame:
    return t.sql(RESULT_ROWS_SQL)


def result_shapes(t: Tables) -> DataFrame:
    """(side, question, row, sort columns): result rows that carry their own column names and types."""
    from pyspark.sql import functions as F

    from ..operators.compare import packed

    def cells(**columns):
        return packed({name: F.expr(sql) for name, sql in columns.items()})
    two = cells(l_partkey="l_partkey", l_quantity="l_quantity")
    gen, shape = F.col("side") == "gen", F.col("shape")
    row = (F.when(gen & (shape == 1), cells(part="l_partkey", qty="l_quantity"))
           .when(~gen & (shape == 2), cells(l_partkey="l_partkey", l_quantity="l_quantity", l_discount="l_discount"))
           .when(~gen & (shape == 3), cells(l_partkey="l_partkey", l_quantity="CAST(l_quantity AS BIGINT)"))
           .when(gen & (shape == 4), cells(l_partkey="CAST(l_partkey AS STRING)", l_quantity="l_quantity"))
           .when(gen & (shape == 5), cells(l_quantity="l_quantity", l_partkey="l_partkey"))
           .when(gen & (shape == 6), cells(l_partkey="CAST(l_partkey AS DECIMAL(12,2))", l_quantity="l_quantity"))
           .otherwise(two))
    return t.sql(RESULT_SHAPES_SQL).select(
        "side", "question", row.alias("row"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


def cte(name: str, sql: str) -> str:
    return f"{name} AS ({sql})"
