"""Oracle side: DuckDB SQL expression text for the text families.

These build plain SQL strings for the DuckDB oracle.  They are written
independently from the Spark Column functions (DuckDB needs the ``'g'`` flag
for global replacement, ``lambda x:`` list functions, ``json_valid``...).
"""

from __future__ import annotations

from ..functions import scoring as S
from ..functions import sqltext as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def cnt(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(ch)}, '')))"


def cnt_word(x: str, w: str) -> str:
    return f"((length({x}) - length(replace({x}, {lit(w)}, ''))) // {len(w)})"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def any_starts(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(w)})" for w in words) + ")"


def first_pos(u: str, words) -> str:
    arms = " ".join(f"WHEN instr({u}, {lit(w)}) > 0 THEN instr({u}, {lit(w)})" for w in words)
    return f"(CASE {arms} ELSE 0 END)"


def extract_sql(r: str) -> str:
    u = f"upper({r})"
    start = first_pos(u, T.EXTRACT_PRIORITY)
    tail = f"substr({r}, greatest({start}, 1))"
    semi = f"instr({tail}, ';')"
    stmt = f"(CASE WHEN {semi} > 0 THEN substr({tail}, 1, {semi}) ELSE {tail} END)"
    return (f"(CASE WHEN regexp_matches({r}, {lit(T.FENCE_SQL)}) "
            f"THEN {strip(f'regexp_extract({r}, {lit(T.FENCE_SQL)}, 1)')} "
            f"WHEN regexp_matches({r}, {lit(T.ANY_STATEMENT)}) AND {start} > 0 THEN {strip(stmt)} "
            f"ELSE {strip(r)} END)")


def extract_json_text(r: str) -> str:
    fenced = strip(f"regexp_extract({r}, {lit(T.FENCE_JSON)}, 1)")
    lo = f"instr({r}, '{{')"
    hi = f"(CASE WHEN instr({r}, '}}') > 0 THEN length({r}) - instr(reverse({r}), '}}') + 1 ELSE 0 END)"
    braces = f"substr({r}, greatest({lo}, 1), {hi} - {lo} + 1)"
    return (f"(CASE WHEN regexp_matches({r}, {lit(T.FENCE_JSON)}) AND json_valid({fenced}) THEN {fenced} "
            f"WHEN {lo} > 0 AND {hi} > {lo} AND json_valid({braces}) THEN {braces} ELSE '{{}}' END)")


def clean_sql(x: str) -> str:
    s = strip(x)
    s = rf"regexp_replace({s}, '^```\w*\n?', '')"
    s = rf"regexp_replace({s}, '\n?```$', '')"
    s = f"regexp_replace({s}, '^```', '')"
    s = f"regexp_replace({s}, '```$', '')"
    pos = first_pos(f"upper({s})", T.CLEAN_PRIORITY)
    s = f"(CASE WHEN {pos} > 0 THEN substr({s}, {pos}) ELSE {s} END)"
    s = strip(f"regexp_replace({s}, ';+$', '')") + " || ';'"
    return collapse(f"({s})")


def validate_error(s: str) -> str:
    u = strip(f"upper({s})")
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' OR {s} = ';' THEN 'Empty SQL query' "
            f"WHEN NOT {any_starts(u, T.VALID_STARTS)} THEN 'Query must start with a valid SQL keyword' "
            f"WHEN {cnt(s, '(')} <> {cnt(s, ')')} THEN 'Unbalanced parentheses' "
            f"WHEN {cnt(s, chr(39))} % 2 <> 0 THEN 'Unbalanced single quotes' END)")


def explain_sql(s: str) -> str:
    u = f"upper({s})"
    first = (f"CASE WHEN contains({u}, 'COUNT(') THEN 'Counts records' "
             f"WHEN contains({u}, 'AVG(') THEN 'Calculates average' "
             f"WHEN contains({u}, 'SUM(') THEN 'Calculates sum' "
             f"WHEN contains({u}, 'MAX(') THEN 'Finds maximum' "
             f"WHEN contains({u}, 'MIN(') THEN 'Finds minimum' ELSE 'Retrieves data' END")
    parts = [f"CASE WHEN contains({u}, 'SELECT') THEN {first} END",
             f"CASE WHEN contains({u}, 'JOIN') THEN 'joins multiple tables' END",
             f"CASE WHEN contains({u}, 'WHERE') THEN 'with filtering conditions' END",
             f"CASE WHEN contains({u}, 'GROUP BY') THEN 'grouped by category' END",
             f"CASE WHEN contains({u}, 'ORDER BY') THEN 'sorted by specified column' END",
             f"CASE WHEN contains({u}, 'LIMIT') THEN 'limited to specific number of results' END"]
    out = "concat_ws(' ', " + ", ".join(parts) + ")"
    return f"(CASE WHEN {out} = '' THEN 'SQL query generated' ELSE {out} END)"


def normalize_sql(s: str) -> str:
    return f"regexp_replace({strip(collapse(f'upper({s})'))}, ';+$', '')"


def no_literals_upper(s: str) -> str:
    x = f"regexp_replace(upper({s}), '''[^'']*''', '''''', 'g')"
    return f"regexp_replace({x}, '\"[^\"]*\"', '''''', 'g')"


KW_LIST = "[" + ", ".join(lit(w) for w in T.SQL_WORDS) + "]"


def tables_of(sql: str) -> str:
    return extract_tables(f"upper({sql})")


def aliases_of(u: str) -> str:
    a = rf"regexp_extract_all({u}, '\b(?:FROM|JOIN)\s+\w+\s+(?:AS\s+)?(\w+)', 1)"
    b = rf"regexp_extract_all({u}, '\bAS\s+(\w+)', 1)"
    return f"list_filter(list_concat({a}, {b}), lambda x: NOT list_contains({KW_LIST}, x))"


def identifiers(clause: str, tables: str, aliases: str) -> str:
    s = rf"regexp_replace({clause}, '\b\w+\s*\(', ' ( ', 'g')"
    s = rf"regexp_replace({s}, '\b\w+\.', '', 'g')"
    toks = rf"regexp_extract_all({s}, '\b[A-Z_][A-Z0-9_]*\b', 0)"
    return (f"list_sort(list_distinct(list_filter({toks}, lambda x: NOT list_contains({KW_LIST}, x) "
            f"AND NOT list_contains({tables}, x) AND NOT list_contains({aliases}, x))))")


WHERE_RE = (r"(?s)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b"
            r"|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|;|$)")
GROUP_RE = (r"(?s)\bGROUP\s+BY\b(.*?)(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b"
            r"|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|\)|;|$)")
ORDER_RE = r"(?s)\bORDER\s+BY\b(.*?)(?:\bLIMIT\b|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|\)|;|$)"


def parts_cte(src: str, key: str, sql_col: str, prefix: str) -> str:
    """SELECT key, <prefix>_tables, <prefix>_columns, ... FROM src (a sub-query body)."""
    u = no_literals_upper(sql_col)
    return f"""
SELECT {key}, list_sort(list_distinct(t)) AS {prefix}_tables,
  {identifiers('u', 't', 'a')} AS {prefix}_columns,
  regexp_matches(u, '\\bWHERE\\b') AS {prefix}_has_where,
  {identifiers(f"regexp_extract(u, {lit(WHERE_RE)}, 1)", 't', 'a')} AS {prefix}_where_cols,
  regexp_matches(u, '\\bGROUP\\s+BY\\b') AS {prefix}_has_group,
  {identifiers(f"regexp_extract(u, {lit(GROUP_RE)}, 1)", 't', 'a')} AS {prefix}_group_cols,
  regexp_matches(u, '\\bORDER\\s+BY\\b') AS {prefix}_has_order,
  {identifiers(f"regexp_extract(u, {lit(ORDER_RE)}, 1)", 't', 'a')} AS {prefix}_order_cols,
  list_sort(list_distinct(regexp_extract_all(u, '\\b(COUNT|SUM|AVG|MIN|MAX)\\s*\\(', 1))) AS {prefix}_aggs
FROM (SELECT {key}, u, t, {aliases_of('u')} AS a
      FROM (SELECT {key}, {u} AS u, {tables_of(sql_col)} AS t FROM {src}) z0) z1
"""


def statement_kind(s: str) -> str:
    u = strip(f"upper({s})")
    first = rf"regexp_extract({u}, '^(\w+)', 1)"
    return (rf"(CASE WHEN regexp_matches({u}, '\bUNION\b') THEN 'UNION' "
            rf"WHEN regexp_matches({u}, '\bINTERSECT\b') THEN 'INTERSECT' "
            rf"WHEN regexp_matches({u}, '\bEXCEPT\b') THEN 'EXCEPT' "
            f"WHEN {first} = 'WITH' THEN 'SELECT' ELSE {first} END)")


def extract_tables(s: str) -> str:
    x = f"regexp_replace({s}, '''[^'']*''', '''''', 'g')"
    x = f"regexp_replace(regexp_replace({x}, {lit(T.LIST_END)}, ';', 'g'), '(?i)\\bjoin\\b', '; from', 'g')"
    lists = f"regexp_extract_all({x}, '(?i)\\bfrom\\s+([^;()]+)', 1)"
    pieces = f"flatten(list_transform({lists}, lambda y: string_split(y, ',')))"
    names = f"list_transform({pieces}, lambda y: translate(regexp_extract(y, {lit(T.TABLE_NAME)}, 1), '\"`[]', ''))"
    return f"list_filter({names}, lambda y: y <> '')"


def columns_of(s: str) -> str:
    """Column names in their own case and in text order."""
    x = f"regexp_replace(regexp_replace({s}, '''[^'']*''', '''''', 'g'), '\"[^\"]*\"', '''''', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\b\\w+\\s*\\(', ' ( ', 'g'), '\\b\\w+\\.', '', 'g')"
    u = no_literals_upper(s)
    return (f"list_filter(regexp_extract_all({x}, '\\b[A-Za-z_][A-Za-z0-9_]*\\b', 0), lambda y: NOT list_contains("
            f"list_concat(list_concat({KW_LIST}, {tables_of(s)}), {aliases_of(u)}), upper(y)))")


def query_type(s: str) -> str:
    u = strip(f"upper({s})")
    sel = (f"CASE WHEN contains({u}, 'COUNT(') THEN 'COUNT' "
           f"WHEN {any_contains(u, ['AVG(', 'SUM(', 'MAX(', 'MIN('])} THEN 'AGGREGATE' "
           f"WHEN contains({u}, 'GROUP BY') THEN 'GROUPBY' WHEN contains({u}, 'JOIN') THEN 'JOIN' "
           f"ELSE 'SELECT' END")
    return (f"(CASE WHEN starts_with({u}, 'SELECT') THEN {sel} WHEN starts_with({u}, 'INSERT') THEN 'INSERT' "
            f"WHEN starts_with({u}, 'UPDATE') THEN 'UPDATE' WHEN starts_with({u}, 'DELETE') THEN 'DELETE' "
            f"ELSE 'UNKNOWN' END)")


def guard_error(s: str) -> str:
    u = strip(f"upper({s})")
    return (f"(CASE WHEN {any_starts(u, T.READ_ONLY)} THEN NULL "
            f"WHEN {any_starts(u, T.MODIFYING)} THEN "
            f"'Modification queries (INSERT/UPDATE/DELETE) are not allowed in read-only mode' "
            f"ELSE 'Unknown query type: ' || substr({s}, 1, 20) || '...' END)")


def question_type(q: str) -> str:
    ql = f"lower({q})"
    arms = " ".join(f"WHEN {any_contains(ql, words)} THEN {lit(name)}" for name, words in T.QUESTION_TYPES)
    return f"(CASE {arms} ELSE 'SELECT' END)"


def question_complexity(q: str) -> str:
    ql = f"lower({q})"
    terms = " + ".join(f"(CASE WHEN {any_contains(ql, words)} THEN {w} ELSE 0 END)" for words, w in T.COMPLEXITY)
    return f"least(1 + {terms}, 5)"


def hardness(s: str) -> str:
    u = f"upper({s})"
    joins = cnt_word(u, " JOIN ")
    fp = f"instr({u}, 'FROM')"
    sub = f"({fp} > 0 AND instr(substr({u}, greatest({fp}, 1)), 'SELECT') > 0)"
    hard = f"({any_contains(u, ['UNION', 'INTERSECT', 'EXCEPT'])} OR {sub} OR {joins} >= 2 OR contains({u}, 'HAVING'))"
    return (f"(CASE WHEN {hard} THEN 'hard' WHEN {joins} = 1 OR contains({u}, 'GROUP BY') THEN 'medium' "
            f"ELSE 'easy' END)")


def easy_keep(s: str) -> str:
    u = f"upper({s})"
    fp = f"instr({u}, 'FROM')"
    return (f"(CASE WHEN {fp} > 0 THEN NOT contains({u}, ' JOIN ') AND instr(substr({u}, greatest({fp}, 1)), "
            f"'SELECT') = 0 ELSE TRUE END)")


def parse_ok(s: str) -> str:
    return (f"({s} IS NOT NULL AND {strip(s)} <> '' AND {cnt(s, '(')} = {cnt(s, ')')} "
            f"AND {cnt(s, chr(39))} % 2 = 0)")


# ---------------------------------------------------------------- scores

def score_syntax(s: str) -> str:
    u = f"upper({s})"
    base = (f"(1.0 - (CASE WHEN NOT {any_starts(strip(u), S.SYNTAX_STARTS)} THEN 0.5 ELSE 0.0 END)"
            f" - (CASE WHEN {cnt(s, '(')} <> {cnt(s, ')')} THEN 0.3 ELSE 0.0 END)"
            f" - (CASE WHEN {cnt(s, chr(39))} % 2 <> 0 THEN 0.2 ELSE 0.0 END)"
            f" - (CASE WHEN NOT ends_with({strip(s)}, ';') THEN 0.1 ELSE 0.0 END))")
    bonus = f"(CASE WHEN contains({u}, 'AS ') AND contains({u}, 'JOIN') THEN least(1.0, {base} + 0.1) ELSE {base} END)"
    return f"(CASE WHEN {s} IS NULL OR {s} = '' THEN 0.0 ELSE greatest(0.0, {bonus}) END)"


def score_execution(ok: str, err: str) -> str:
    e = f"lower(coalesce({err}, ''))"
    return (f"(CASE WHEN {ok} THEN 1.0 "
            f"WHEN contains({e}, 'no such table') OR contains({e}, 'table_or_view_not_found') THEN 0.2 "
            f"WHEN contains({e}, 'no such column') OR contains({e}, 'unresolved_column') THEN 0.3 "
            f"WHEN contains({e}, 'syntax error') OR contains({e}, 'parse_syntax_error') THEN 0.1 ELSE 0.0 END)")


def score_semantic(q: str, s: str, ok: str, n: str) -> str:
    ql, u = f"lower({q})", f"upper({s})"
    cnt_part = (f"(CASE WHEN {any_contains(ql, S.COUNT_WORDS)} THEN "
                f"(CASE WHEN contains({u}, 'COUNT(') THEN 0.25 ELSE -0.25 END) ELSE 0.0 END)")
    arms = " ".join(f"WHEN contains({ql}, {lit(w)}) THEN (CASE WHEN contains({u}, {lit(fn)}) THEN 0.2 ELSE 0.0 END)"
                    for w, fn in S.AGG_WORDS)
    agg = f"(CASE {arms} ELSE 0.0 END)"
    rows = f"(CASE WHEN {n} > 0 THEN 0.15 ELSE 0.0 END)"
    return f"(CASE WHEN {ok} THEN least(1.0, 0.5 + {cnt_part} + {agg} + {rows}) ELSE 0.0 END)"


def score_efficiency(s: str) -> str:
    u = f"upper(coalesce({s}, ''))"
    base = (f"(1.0 - (CASE WHEN contains({u}, 'SELECT *') THEN 0.2 ELSE 0.0 END)"
            f" - (CASE WHEN (contains({u}, 'DELETE') OR contains({u}, 'UPDATE')) AND NOT contains({u}, 'WHERE')"
            f" THEN 0.5 ELSE 0.0 END)"
            f" - (CASE WHEN {cnt_word(u, 'SELECT')} - 1 > 2 THEN 0.2 ELSE 0.0 END))")
    return f"greatest(0.0, CASE WHEN contains({u}, 'LIMIT') THEN least(1.0, {base} + 0.1) ELSE {base} END)"


def feedback(s: str, q: str, ok: str, err: str, n: str) -> str:
    u = f"upper(coalesce({s}, ''))"
    sx = f"coalesce({s}, '')"
    ql = f"lower({q})"
    el = f"lower(coalesce({err}, ''))"
    empty = f"({sx} = '')"
    has_err = f"({err} IS NOT NULL AND {err} <> '')"
    items = [
        f"CASE WHEN {empty} THEN 'No SQL query provided' END",
        f"CASE WHEN NOT {empty} AND NOT {any_starts(strip(u), S.SYNTAX_STARTS)} THEN 'Query doesn''t start with a valid SQL keyword' END",
        f"CASE WHEN NOT {empty} AND {cnt(sx, '(')} <> {cnt(sx, ')')} THEN 'Unbalanced parentheses' END",
        f"CASE WHEN NOT {empty} AND {cnt(sx, chr(39))} % 2 <> 0 THEN 'Unbalanced single quotes' END",
        f"CASE WHEN NOT {empty} AND NOT ends_with({strip(sx)}, ';') THEN 'Query should end with semicolon' END",
        f"CASE WHEN NOT {empty} AND contains({u}, 'AS ') AND contains({u}, 'JOIN') THEN 'Good: Uses aliases with JOINs' END",
        f"CASE WHEN {ok} THEN 'Query executed successfully' END",
        f"CASE WHEN NOT {ok} AND {has_err} THEN 'Execution failed: ' || {err} END",
        f"CASE WHEN NOT {ok} AND {has_err} THEN (CASE WHEN {any_contains(el, S.TABLE_ERRORS)} THEN 'Table name might be incorrect' "
        f"WHEN {any_contains(el, S.COLUMN_ERRORS)} THEN 'Column name might be incorrect' "
        f"WHEN {any_contains(el, S.SYNTAX_ERRORS)} THEN 'SQL syntax needs correction' END) END",
        f"CASE WHEN {ok} AND {any_contains(ql, S.COUNT_WORDS)} THEN (CASE WHEN contains({u}, 'COUNT(') "
        f"THEN 'Correctly uses COUNT for counting question' ELSE 'Question asks for count but query doesn''t use COUNT' END) END",
        f"CASE WHEN {ok} THEN (CASE " + " ".join(
            f"WHEN contains({ql}, {lit(w)}) THEN (CASE WHEN contains({u}, {lit(fn)}) THEN {lit('Correctly uses ' + fn[:-1] + ' for ' + w + ' question')} END)"
            for w, fn in S.AGG_WORDS) + " END) END",
        f"CASE WHEN {ok} THEN (CASE WHEN {n} > 0 THEN 'Query returned ' || CAST({n} AS VARCHAR) || ' results' "
        f"ELSE 'Query returned no results' END) END",
        f"CASE WHEN contains({u}, 'SELECT *') THEN 'Consider selecting specific columns instead of *' END",
        f"CASE WHEN (contains({u}, 'DELETE') OR contains({u}, 'UPDATE')) AND NOT contains({u}, 'WHERE') "
        f"THEN 'UPDATE/DELETE without WHERE clause is risky' END",
        f"CASE WHEN contains({u}, 'DISTINCT') THEN 'Uses DISTINCT - ensure it''s necessary' END",
        f"CASE WHEN {cnt_word(u, 'SELECT')} - 1 > 2 THEN 'Multiple subqueries may impact performance' END",
        f"CASE WHEN contains({u}, 'LIMIT') THEN 'Good: Uses LIMIT to restrict results' END",
    ]
    return "concat_ws(' | ', " + ", ".join(items) + ")"
