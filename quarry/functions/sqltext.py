"""SQL text and question text as Column -> Column functions.

Every function here is a composition of built-in expressions (regexp_*,
instr, substr, when, higher-order array functions) so it runs inside
whole-stage codegen on the JVM, row by row, with no Python in the path.
Semantics follow the keyword/substring rules of the original helpers; the
parser-based parts are re-aimed as regular expressions (see README).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col_, collapse_ws, contains_any, count_sub, starts_any, strip_ws

# Keyword lists of the rules below, in their original order.
EXTRACT_PRIORITY = ["SELECT", "INSERT", "UPDATE", "DELETE"]
CLEAN_PRIORITY = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE"]
VALID_STARTS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
READ_ONLY = ["SELECT"]
MODIFYING = ["INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"]
QUESTION_TYPES = [
    ("COUNT", ["how many", "count", "number of", "total number"]),
    ("AGGREGATE", ["average", "avg", "sum", "total", "maximum", "max", "minimum", "min"]),
    ("GROUPBY", ["each", "per", "by category", "grouped", "for each"]),
    ("ORDERBY", ["top", "highest", "lowest", "most", "least", "ranked", "sorted"]),
    ("JOIN", ["and their", "along with", "with their", "related", "associated"]),
    ("FILTER", ["where", "which", "that have", "with", "whose"]),
]
COMPLEXITY = [
    (["and", "also", "as well as"], 1),
    (["join", "combine", "merge"], 1),
    (["group by", "for each", "per"], 1),
    (["subquery", "nested", "within"], 2),
    (["having", "where", "filter"], 1),
    (["order by", "sort", "rank"], 1),
]
# Words that are never column names when columns are read off SQL text.
SQL_WORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "GLOB",
    "BETWEEN", "AS", "ON", "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS", "NATURAL",
    "USING", "GROUP", "BY", "ORDER", "HAVING", "LIMIT", "OFFSET", "DISTINCT", "ALL", "ASC", "DESC",
    "CASE", "WHEN", "THEN", "ELSE", "END", "EXISTS", "UNION", "INTERSECT", "EXCEPT", "WITH",
    "INSERT", "INTO", "VALUES", "UPDATE", "SET", "DELETE", "CREATE", "TABLE", "ALTER", "DROP",
    "TRUE", "FALSE", "COUNT", "SUM", "AVG", "MIN", "MAX", "CAST",
]
AGG_FUNCS = ["COUNT", "SUM", "AVG", "MIN", "MAX"]

FENCE_SQL = r"(?is)```(?:sql)?\s*(.*?)```"
FENCE_JSON = r"(?is)```(?:json)?\s*(.*?)```"
ANY_STATEMENT = r"(?i)(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\s"


def _first_pos(upper_text: Column, words) -> Column:
    """1-based position of the first word of ``words`` (in list order) that occurs; 0 if none."""
    out = F.lit(0)
    for w in reversed(words):
        out = F.when(F.instr(upper_text, w) > 0, F.instr(upper_text, w)).otherwise(out)
    return out


def extract_sql(response) -> Column:
    """SQL out of a model response (fenced block, else statement, else text)."""
    r = col_(response)
    u = F.upper(r)
    start = _first_pos(u, EXTRACT_PRIORITY)
    tail = r.substr(F.greatest(start, F.lit(1)), F.length(r))
    semi = F.instr(tail, ";")
    stmt = F.when(semi > 0, tail.substr(F.lit(1), semi)).otherwise(tail)
    return (F.when(r.rlike(FENCE_SQL), strip_ws(F.regexp_extract(r, FENCE_SQL, 1)))
            .when(r.rlike(ANY_STATEMENT) & (start > 0), strip_ws(stmt))
            .otherwise(strip_ws(r)))


def extract_json_text(response) -> Column:
    """The JSON object text in a response ('{}' when none parses)."""
    r = col_(response)
    fenced = strip_ws(F.regexp_extract(r, FENCE_JSON, 1))
    lo = F.instr(r, "{")
    # last '}' = length - position of '}' in the reversed string + 1
    hi = F.when(F.instr(r, "}") > 0, F.length(r) - F.instr(F.reverse(r), "}") + 1).otherwise(0)
    braces = r.substr(F.greatest(lo, F.lit(1)), hi - lo + 1)

    def valid(x):
        return F.try_parse_json(x).isNotNull()

    return (F.when(r.rlike(FENCE_JSON) & valid(fenced), fenced)
            .when((lo > 0) & (hi > lo) & valid(braces), braces)
            .otherwise(F.lit("{}")))


PLAN_SCHEMA = ("query_type string, required_tables array<string>, required_columns array<string>, "
               "operations array<string>, complexity int, reasoning string")


def parse_plan(plan_response, question) -> Column:
    """Plan struct; no plan -> question-type fallback with complexity 2."""
    txt = extract_json_text(plan_response)
    p = F.from_json(txt, PLAN_SCHEMA)
    empty = txt == "{}"
    return F.struct(
        F.when(empty, question_type(question))
         .otherwise(F.coalesce(p["query_type"], F.lit("SELECT"))).alias("query_type"),
        F.when(empty, F.array().cast("array<string>")).otherwise(p["required_tables"]).alias("required_tables"),
        F.when(empty, F.array().cast("array<string>")).otherwise(p["required_columns"]).alias("required_columns"),
        F.when(empty, F.lit(2)).otherwise(p["complexity"]).alias("complexity"),
        empty.alias("fallback"))


def clean_sql(sql) -> Column:
    """C4: trim, drop fence markers, cut before the first keyword (by priority), one ';', collapse spaces."""
    s = strip_ws(sql)
    s = F.regexp_replace(s, r"^```\w*\n?", "")
    s = F.regexp_replace(s, r"\n?```$", "")
    s = F.regexp_replace(s, r"^```", "")
    s = F.regexp_replace(s, r"```$", "")
    pos = _first_pos(F.upper(s), CLEAN_PRIORITY)
    s = F.when(pos > 0, s.substr(pos, F.length(s))).otherwise(s)
    s = F.concat(strip_ws(F.regexp_replace(s, ";+$", "")), F.lit(";"))
    return collapse_ws(s)


def validate_error(sql) -> Column:
    """First failing check as text, NULL when the SQL passes."""
    s = col_(sql)
    u = strip_ws(F.upper(s))
    return (F.when(s.isNull() | (s == "") | (s == ";"), F.lit("Empty SQL query"))
            .when(~starts_any(u, VALID_STARTS), F.lit("Query must start with a valid SQL keyword"))
            .when(count_sub(s, "(") != count_sub(s, ")"), F.lit("Unbalanced parentheses"))
            .when(count_sub(s, "'") % 2 != 0, F.lit("Unbalanced single quotes")))


def explain_sql(sql) -> Column:
    """One sentence from keyword flags."""
    u = F.upper(col_(sql))
    first = (F.when(u.contains("COUNT("), "Counts records")
             .when(u.contains("AVG("), "Calculates average")
             .when(u.contains("SUM("), "Calculates sum")
             .when(u.contains("MAX("), "Finds maximum")
             .when(u.contains("MIN("), "Finds minimum")
             .otherwise("Retrieves data"))
    parts = [F.when(u.contains("SELECT"), first),
             F.when(u.contains("JOIN"), F.lit("joins multiple tables")),
             F.when(u.contains("WHERE"), F.lit("with filtering conditions")),
             F.when(u.contains("GROUP BY"), F.lit("grouped by category")),
             F.when(u.contains("ORDER BY"), F.lit("sorted by specified column")),
             F.when(u.contains("LIMIT"), F.lit("limited to specific number of results"))]
    out = F.concat_ws(" ", *parts)
    return F.when(out == "", F.lit("SQL query generated")).otherwise(out)


def normalize_sql(sql) -> Column:
    """Upper-case, collapse whitespace, trim, drop trailing ';'."""
    s = strip_ws(collapse_ws(F.upper(col_(sql))))
    return F.regexp_replace(s, ";+$", "")


def _no_literals(upper_sql: Column) -> Column:
    s = F.regexp_replace(upper_sql, r"'[^']*'", "''")
    return F.regexp_replace(s, r'"[^"]*"', "''")


# A FROM list ends at these words; JOIN starts a list of its own.
LIST_END = (r"(?i)\b(?:where|on|using|group|order|having|limit|union|intersect|except|set|values|select|"
            r"inner|left|right|full|cross|outer|natural)\b")
NAME = r'"[^"]*"|`[^`]*`|\[[^\]]*\]|\w+'
TABLE_NAME = rf"^\s*(?:(?:{NAME})\s*\.\s*)*({NAME})"


def extract_tables(sql) -> Column:
    """Table names after FROM / JOIN, in order, repeats kept.

    Comma lists give every table; a qualified name gives its last part;
    quotes around a name are dropped.
    """
    s = F.regexp_replace(col_(sql), r"'[^']*'", "''")
    s = F.regexp_replace(F.regexp_replace(s, LIST_END, ";"), r"(?i)\bjoin\b", "; from")
    lists = F.regexp_extract_all(s, F.lit(r"(?i)\bfrom\s+([^;()]+)"), 1)
    pieces = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    names = F.transform(pieces, lambda x: F.translate(F.regexp_extract(x, TABLE_NAME, 1), '"`[]', ""))
    return F.filter(names, lambda x: x != "")


def _kw_array() -> Column:
    return F.array(*[F.lit(w) for w in SQL_WORDS])


def _aliases(u: Column) -> Column:
    a = F.regexp_extract_all(u, F.lit(r"\b(?:FROM|JOIN)\s+\w+\s+(?:AS\s+)?(\w+)"), 1)
    b = F.regexp_extract_all(u, F.lit(r"\bAS\s+(\w+)"), 1)
    # membership only: array_except also de-duplicates, which is fine here
    return F.array_except(F.concat(a, b), _kw_array())


def _identifiers(clause: Column, tables: Column, aliases: Column) -> Column:
    """Distinct identifiers of a clause minus keywords, tables and aliases (sorted).

    ``array_except`` is a built-in set difference (no interpreted lambda).
    """
    s = F.regexp_replace(clause, r"\b\w+\s*\(", " ( ")
    s = F.regexp_replace(s, r"\b\w+\.", "")
    toks = F.regexp_extract_all(s, F.lit(r"\b[A-Z_][A-Z0-9_]*\b"), 0)
    keep = F.array_except(F.array_except(F.array_except(toks, _kw_array()), tables), aliases)
    return F.sort_array(keep)


PART_FIELDS = ("tables", "columns", "has_where", "where_cols", "has_group", "group_cols",
               "has_order", "order_cols", "aggs")


def _clauses(u: Column):
    where_ = F.regexp_extract(u, r"(?s)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b"
                                 r"|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|;|$)", 1)
    group_ = F.regexp_extract(u, r"(?s)\bGROUP\s+BY\b(.*?)(?:\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b"
                                 r"|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b|\)|;|$)", 1)
    order_ = F.regexp_extract(u, r"(?s)\bORDER\s+BY\b(.*?)(?:\bLIMIT\b|\bUNION\b|\bINTERSECT\b"
                                 r"|\bEXCEPT\b|\)|;|$)", 1)
    return where_, group_, order_


def with_sql_parts(df, sql: str, prefix: str):
    """Add the clause pieces of ``sql`` as top-level columns ``<prefix>_<field>``.

    Two projections: the blanked upper-case text, table and alias lists are
    computed once per row, then every clause reads them (an expensive column
    used many times is not inlined again by the optimizer).
    """
    u, tb, al = f"{prefix}__u", f"{prefix}__t", f"{prefix}__a"
    base = _no_literals(F.upper(F.col(sql)))
    df = df.withColumn(u, base)
    df = df.withColumns({tb: extract_tables(F.upper(F.col(sql))),
                         al: _aliases(F.col(u))})
    where_, group_, order_ = _clauses(F.col(u))
    t_, a_ = F.col(tb), F.col(al)
    cols = {
        "tables": F.sort_array(F.array_distinct(t_)),
        "columns": _identifiers(F.col(u), t_, a_),
        "has_where": F.col(u).rlike(r"\bWHERE\b"),
        "where_cols": _identifiers(where_, t_, a_),
        "has_group": F.col(u).rlike(r"\bGROUP\s+BY\b"),
        "group_cols": _identifiers(group_, t_, a_),
        "has_order": F.col(u).rlike(r"\bORDER\s+BY\b"),
        "order_cols": _identifiers(order_, t_, a_),
        "aggs": F.sort_array(F.array_distinct(
            F.regexp_extract_all(F.col(u), F.lit(r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\("), 1))),
    }
    # one projection per stage (a withColumn per field would re-analyse the plan each time)
    df = df.withColumns({f"{prefix}_{k}": v for k, v in cols.items()})
    return df.drop(u, tb, al)


def with_columns_of(df, sql: str, out: str):
    """Column names referenced, in their own case and in text order, repeats kept.

    Adds the array column ``out``.  The upper-case words left out are an element
    that the filter around them is given, computed once a row: as a column of an
    earlier projection the optimizer would put them, regular expressions and all,
    into the filter, to be computed again for every word of a statement.
    """
    s = F.regexp_replace(F.regexp_replace(F.col(sql), r"'[^']*'", "''"), r'"[^"]*"', "''")
    body = F.regexp_replace(F.regexp_replace(s, r"\b\w+\s*\(", " ( "), r"\b\w+\.", "")
    u = _no_literals(F.upper(F.col(sql)))
    names = F.regexp_extract_all(body, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), 0)
    left_out = F.concat(_kw_array(), extract_tables(F.upper(F.col(sql))), _aliases(u))
    row = F.array(F.struct(names.alias("names"), left_out.alias("out")))
    kept = F.transform(row, lambda r: F.filter(r["names"], lambda x: ~F.array_contains(r["out"], F.upper(x))))
    return df.withColumn(out, F.element_at(kept, 1))


def statement_kind(sql) -> Column:
    """Statement class used by C8: set operation, else leading keyword (WITH reads as SELECT)."""
    u = strip_ws(F.upper(col_(sql)))
    first = F.regexp_extract(u, r"^(\w+)", 1)
    return (F.when(u.rlike(r"\bUNION\b"), "UNION").when(u.rlike(r"\bINTERSECT\b"), "INTERSECT")
            .when(u.rlike(r"\bEXCEPT\b"), "EXCEPT").when(first == "WITH", "SELECT").otherwise(first))


def semantic_similar(a, b) -> Column:
    """Same statement kind and same table set."""
    ta = F.sort_array(F.array_distinct(extract_tables(a)))
    tb = F.sort_array(F.array_distinct(extract_tables(b)))
    return (statement_kind(a) == statement_kind(b)) & (ta == tb)


COMPARE_FIELDS = ("exact_match", "normalized_match", "semantic_similar", "sql1_normalized", "sql2_normalized",
                  "differences")


def compare_sql_df(df, a: str, b: str):
    """C8 as columns: matches, both normalized texts and the list of differences.

    Table and column lists are computed once in a first projection.
    """
    def text(x):
        return F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))

    for name, sql in (("_1", a), ("_2", b)):
        df = with_columns_of(df, sql, name + "c")
        df = df.withColumns({name + "t": F.sort_array(F.array_distinct(extract_tables(sql))),
                             name + "c": F.sort_array(F.array_distinct(F.col(name + "c"))),
                             name + "n": normalize_sql(sql), name + "k": statement_kind(sql)})
    c = F.col
    diff = F.array_compact(F.array(
        F.when(c("_1t") != c("_2t"), F.concat(F.lit("Tables: "), text(c("_1t")), F.lit(" vs "), text(c("_2t")))),
        F.when(c("_1c") != c("_2c"), F.concat(F.lit("Columns: "), text(c("_1c")), F.lit(" vs "), text(c("_2c"))))))
    df = df.withColumns({
        "exact_match": strip_ws(c(a)) == strip_ws(c(b)), "normalized_match": c("_1n") == c("_2n"),
        "semantic_similar": (c("_1k") == c("_2k")) & (c("_1t") == c("_2t")),
        "sql1_normalized": c("_1n"), "sql2_normalized": c("_2n"), "differences": diff})
    return df.drop(*[p + k for p in ("_1", "_2") for k in "tcnk"])


def relevant_tables(sql, table_names) -> Column:
    """C11: known tables referenced as ``from t``, ``join t``, ``t as`` or ``t.``."""
    low = F.lower(col_(sql))
    hits = []
    for t in table_names:
        tl = t.lower()
        pat = rf"\bfrom\s+{tl}\b|\bjoin\s+{tl}\b|\b{tl}\s+as\b|\b{tl}\."
        hits.append(F.when(low.rlike(pat), F.lit(tl)))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*hits))))


def named_tables(sql) -> Column:
    """Lower-case words that a statement uses as ``from w``, ``join w``, ``w as`` or ``w.``; each once."""
    low = F.lower(col_(sql))
    # what follows or precedes is looked at, not consumed, so that uses may overlap
    uses = [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in (
        r"\b(?:from|join)(?=\s+(\w+))", r"\b(\w+)(?=\s+as\b)", r"\b(\w+)(?=\.)")]
    return F.array_distinct(F.concat(*uses))


def relevant_tables_of(log: DataFrame, sql: str, catalog: DataFrame, key: str = "qid") -> DataFrame:
    """C11 over many databases: (key, relevant_tables), the tables of the question's own database that its SQL names.

    ``log`` has (key, db_id, sql), ``catalog`` one row a table (db_id, table) of
    any number of databases.  Names are matched by a join on (db_id, name), so
    the work grows with the names used and not with the tables known.  Table
    names are words; other names are not found.  A null statement or database,
    or a database that is not in the catalog, has no tables.
    """
    known = catalog.select("db_id", F.lower("table").alias("_name")).distinct()
    used = log.select(key, "db_id", F.explode(named_tables(sql)).alias("_name")).join(known, ["db_id", "_name"])
    found = used.groupBy(key).agg(F.sort_array(F.collect_set("_name")).alias("relevant_tables"))
    none = F.array().cast("array<string>")
    return log.select(key).join(found, key, "left").withColumn("relevant_tables", F.coalesce("relevant_tables", none))


def ddl_table_names(text) -> Column:
    """Distinct names of ``CREATE TABLE x`` statements."""
    return F.sort_array(F.array_distinct(
        F.regexp_extract_all(col_(text), F.lit(r"(?i)CREATE TABLE\s+(\w+)"), 1)))


def query_type(sql) -> Column:
    """SQL statement class by prefix and substrings."""
    u = strip_ws(F.upper(col_(sql)))
    sel = (F.when(u.contains("COUNT("), "COUNT")
           .when(contains_any(u, ["AVG(", "SUM(", "MAX(", "MIN("]), "AGGREGATE")
           .when(u.contains("GROUP BY"), "GROUPBY")
           .when(u.contains("JOIN"), "JOIN")
           .otherwise("SELECT"))
    return (F.when(u.startswith("SELECT"), sel)
            .when(u.startswith("INSERT"), "INSERT")
            .when(u.startswith("UPDATE"), "UPDATE")
            .when(u.startswith("DELETE"), "DELETE")
            .otherwise("UNKNOWN"))


def read_only_guard(sql, allow_modifications: bool = False) -> Column:
    """C14: struct(allowed, error) of the execution gate."""
    s = col_(sql)
    u = strip_ws(F.upper(s))
    ro = starts_any(u, READ_ONLY)
    mod = starts_any(u, MODIFYING)
    err = (F.when(ro, F.lit(None).cast("string"))
           .when(mod, F.lit(None).cast("string") if allow_modifications else
                 F.lit("Modification queries (INSERT/UPDATE/DELETE) are not allowed in read-only mode"))
           .otherwise(F.concat(F.lit("Unknown query type: "), s.substr(1, 20), F.lit("..."))))
    return F.struct(err.isNull().alias("allowed"), err.alias("error"))


def question_type(question) -> Column:
    """First keyword group (substring match) of the lower-cased question."""
    q = F.lower(col_(question))
    out = F.lit("SELECT")
    for name, words in reversed(QUESTION_TYPES):
        out = F.when(contains_any(q, words), F.lit(name)).otherwise(out)
    return out


def question_complexity(question) -> Column:
    """1 + weight of every matched keyword group, capped at 5."""
    q = F.lower(col_(question))
    total = F.lit(1)
    for words, w in COMPLEXITY:
        total = total + F.when(contains_any(q, words), F.lit(w)).otherwise(F.lit(0))
    return F.least(total, F.lit(5))


def hardness(sql) -> Column:
    """C17: easy / medium / hard from set operations, sub-selects, joins, GROUP BY, HAVING."""
    u = F.upper(col_(sql))
    joins = count_sub(u, " JOIN ")
    from_pos = F.instr(u, "FROM")
    sub = (from_pos > 0) & (F.instr(u.substr(F.greatest(from_pos, F.lit(1)), F.length(u)), "SELECT") > 0)
    hard = contains_any(u, ["UNION", "INTERSECT", "EXCEPT"]) | sub | (joins >= 2) | u.contains("HAVING")
    return (F.when(hard, "hard")
            .when((joins == 1) | u.contains("GROUP BY"), "medium")
            .otherwise("easy"))


def easy_filter(sql) -> Column:
    """No ' JOIN ' and no SELECT after FROM (kept when there is no FROM)."""
    u = F.upper(col_(sql))
    from_pos = F.instr(u, "FROM")
    after = u.substr(F.greatest(from_pos, F.lit(1)), F.length(u))
    return F.when(from_pos > 0, ~u.contains(" JOIN ") & (F.instr(after, "SELECT") == 0)).otherwise(True)


def parse_ok(sql) -> Column:
    """Stand-in for "the parser accepted it": the structural checks of C5 pass."""
    s = col_(sql)
    return (s.isNotNull() & (strip_ws(s) != "") & (count_sub(s, "(") == count_sub(s, ")"))
            & (count_sub(s, "'") % 2 == 0))


def component_flags(gen: str, gold: str, g: str = "g", o: str = "o"):
    """C19 over columns added by ``with_sql_parts`` (prefixes ``g`` / ``o``)."""
    ok = parse_ok(gen) & parse_ok(gold)

    def fld(p, k):
        return F.col(f"{p}_{k}")

    def clause(has, cols):
        return (F.when(fld(g, has) & fld(o, has), fld(g, cols) == fld(o, cols))
                .otherwise(~fld(g, has) & ~fld(o, has)))

    raw = [fld(g, "aggs") == fld(o, "aggs"), fld(g, "tables") == fld(o, "tables"),
           clause("has_where", "where_cols"), clause("has_group", "group_cols"),
           clause("has_order", "order_cols")]
    flags = [F.when(ok, x).otherwise(F.lit(False)) for x in raw]
    names = ["select_match", "from_match", "where_match", "groupby_match", "orderby_match"]
    return dict(zip(names, flags))


def component_match_df(df, gen: str, gold: str):
    """C19 as columns: five clause matches and their mean (``component_score``)."""
    df = with_sql_parts(with_sql_parts(df, gen, "g"), gold, "o")
    flags = component_flags(gen, gold)
    df = df.withColumns(flags)
    score = sum(F.col(k).cast("int") for k in flags) / 5.0
    df = df.withColumn("component_score", score)
    return df.drop(*[f"{p}_{k}" for p in ("g", "o") for k in PART_FIELDS])
