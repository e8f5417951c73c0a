"""Rule-based quality scores of generated SQL, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, contains_any, count_sub, starts_any, strip_ws

# Score weights, keyword tables and error classes of the
# evaluator; the message texts in ``feedback`` are fixed values too.
TABLE_ERRORS = ["no such table", "table_or_view_not_found"]
COLUMN_ERRORS = ["no such column", "unresolved_column"]
SYNTAX_ERRORS = ["syntax error", "parse_syntax_error"]
SYNTAX_STARTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE"]
WEIGHTS = {"syntax": 0.15, "execution": 0.35, "semantic": 0.35, "efficiency": 0.15}
COUNT_WORDS = ["how many", "count", "number of"]
AGG_WORDS = [("average", "AVG("), ("avg", "AVG("), ("sum", "SUM("), ("total", "SUM("),
             ("maximum", "MAX("), ("max", "MAX("), ("minimum", "MIN("), ("min", "MIN(")]
FINAL_WEIGHTS = (0.5, 0.3, 0.2)


def score_syntax(sql) -> Column:
    """C20."""
    s = col_(sql)
    u = F.upper(s)
    score = (F.lit(1.0)
             - F.when(~starts_any(strip_ws(u), SYNTAX_STARTS), 0.5).otherwise(0.0)
             - F.when(count_sub(s, "(") != count_sub(s, ")"), 0.3).otherwise(0.0)
             - F.when(count_sub(s, "'") % 2 != 0, 0.2).otherwise(0.0)
             - F.when(~strip_ws(s).endswith(";"), 0.1).otherwise(0.0))
    score = F.when(u.contains("AS ") & u.contains("JOIN"), F.least(F.lit(1.0), score + 0.1)).otherwise(score)
    return F.when(s.isNull() | (s == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), score))


def score_execution(success, error) -> Column:
    """1.0 on success, partial credit by error class."""
    e = F.lower(F.coalesce(col_(error), F.lit("")))
    return (F.when(col_(success), 1.0)
            .when(contains_any(e, TABLE_ERRORS), 0.2)
            .when(contains_any(e, COLUMN_ERRORS), 0.3)
            .when(contains_any(e, SYNTAX_ERRORS), 0.1)
            .otherwise(0.0))


def score_semantic(question, sql, success, n_rows) -> Column:
    """0 unless the SQL ran; else keyword agreement plus non-empty result."""
    q = F.lower(col_(question))
    u = F.upper(col_(sql))
    score = F.lit(0.5)
    score = score + F.when(contains_any(q, COUNT_WORDS),
                           F.when(u.contains("COUNT("), 0.25).otherwise(-0.25)).otherwise(0.0)
    agg = F.lit(0.0)
    for word, fn in reversed(AGG_WORDS):  # first matching word decides
        agg = F.when(q.contains(word), F.when(u.contains(fn), 0.2).otherwise(0.0)).otherwise(agg)
    score = score + agg + F.when(col_(n_rows) > 0, 0.15).otherwise(0.0)
    return F.when(col_(success), F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def score_efficiency(sql) -> Column:
    """C23."""
    u = F.upper(F.coalesce(col_(sql), F.lit("")))
    score = (F.lit(1.0)
             - F.when(u.contains("SELECT *"), 0.2).otherwise(0.0)
             - F.when((u.contains("DELETE") | u.contains("UPDATE")) & ~u.contains("WHERE"), 0.5).otherwise(0.0)
             - F.when(count_sub(u, "SELECT") - 1 > 2, 0.2).otherwise(0.0))
    score = F.when(u.contains("LIMIT"), F.least(F.lit(1.0), score + 0.1)).otherwise(score)
    return F.greatest(F.lit(0.0), score)


def score_overall(syntax, execution, semantic, efficiency) -> Column:
    """Weighted sum of the four scores."""
    return (col_(syntax) * WEIGHTS["syntax"] + col_(execution) * WEIGHTS["execution"]
            + col_(semantic) * WEIGHTS["semantic"] + col_(efficiency) * WEIGHTS["efficiency"])


def feedback(sql, question, success, error, n_rows) -> Column:
    """C24 feedback messages in the order the four checks run (NULL entries dropped)."""
    s = F.coalesce(col_(sql), F.lit(""))
    u = F.upper(s)
    q = F.lower(col_(question))
    ok = col_(success)
    err = col_(error)
    el = F.lower(F.coalesce(err, F.lit("")))
    empty = s == ""
    has_err = err.isNotNull() & (err != "")
    items = [
        # syntax
        F.when(empty, F.lit("No SQL query provided")),
        F.when(~empty & ~starts_any(strip_ws(u), SYNTAX_STARTS),
               F.lit("Query doesn't start with a valid SQL keyword")),
        F.when(~empty & (count_sub(s, "(") != count_sub(s, ")")), F.lit("Unbalanced parentheses")),
        F.when(~empty & (count_sub(s, "'") % 2 != 0), F.lit("Unbalanced single quotes")),
        F.when(~empty & ~strip_ws(s).endswith(";"), F.lit("Query should end with semicolon")),
        F.when(~empty & u.contains("AS ") & u.contains("JOIN"), F.lit("Good: Uses aliases with JOINs")),
        # execution
        F.when(ok, F.lit("Query executed successfully")),
        F.when(~ok & has_err, F.concat(F.lit("Execution failed: "), err)),
        F.when(~ok & has_err, F.when(contains_any(el, TABLE_ERRORS), F.lit("Table name might be incorrect"))
               .when(contains_any(el, COLUMN_ERRORS), F.lit("Column name might be incorrect"))
               .when(contains_any(el, SYNTAX_ERRORS), F.lit("SQL syntax needs correction"))),
    ]
    # semantics (only after a successful run)
    cnt = F.when(contains_any(q, COUNT_WORDS),
                 F.when(u.contains("COUNT("), F.lit("Correctly uses COUNT for counting question"))
                 .otherwise(F.lit("Question asks for count but query doesn't use COUNT")))
    agg = F.lit(None).cast("string")
    for word, fn in reversed(AGG_WORDS):
        agg = F.when(q.contains(word), F.when(u.contains(fn), F.lit(f"Correctly uses {fn[:-1]} for {word} question"))
                     ).otherwise(agg)
    rows = F.when(col_(n_rows) > 0, F.concat(F.lit("Query returned "), col_(n_rows).cast("string"),
                                             F.lit(" results"))).otherwise(F.lit("Query returned no results"))
    items += [F.when(ok, cnt), F.when(ok, agg), F.when(ok, rows)]
    # efficiency
    items += [
        F.when(u.contains("SELECT *"), F.lit("Consider selecting specific columns instead of *")),
        F.when((u.contains("DELETE") | u.contains("UPDATE")) & ~u.contains("WHERE"),
               F.lit("UPDATE/DELETE without WHERE clause is risky")),
        F.when(u.contains("DISTINCT"), F.lit("Uses DISTINCT - ensure it's necessary")),
        F.when(count_sub(u, "SELECT") - 1 > 2, F.lit("Multiple subqueries may impact performance")),
        F.when(u.contains("LIMIT"), F.lit("Good: Uses LIMIT to restrict results")),
    ]
    return F.concat_ws(" | ", *items)


def score_final(exec_correct, component, semantic_similar) -> Column:
    """0.5 * execution correct + 0.3 * component score + 0.2 * same statement & tables."""
    a, b, c = FINAL_WEIGHTS
    return (a * col_(exec_correct).cast("double") + b * col_(component)
            + c * col_(semantic_similar).cast("double"))
