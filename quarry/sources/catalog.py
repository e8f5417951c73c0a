"""Catalog metadata of the fixture database.

The column table is read off the parquet schemas of the tables themselves
(driver-side metadata, bounded by the number of columns); keys are declared
here because parquet carries none.  Everything downstream (DDL text, key
checks, value samples) is an ordinary DataFrame job over that table and the
data tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TABLE_NAMES, Tables
from .profile import column_profile, sample_texts, smallest_values

DB_NAME = "tpch"

# Declared primary keys and foreign-key edges of the fixture.
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
TEXT_TYPES = ("string",)
SAMPLE_SIZE = 20

COLUMNS_SCHEMA = ("db_name string, table_order int, table string, ordinal int, name string, type string, "
                  "not_null boolean, default string, primary_key boolean")


def schema_columns(t: Tables) -> DataFrame:
    """A4: one row per column of every table."""
    rows = []
    for ti, name in enumerate(TABLE_NAMES):
        for i, f in enumerate(t[name].schema.fields, start=1):
            rows.append((DB_NAME, ti, name, i, f.name, f.dataType.simpleString(), not f.nullable, None,
                         f.name in PRIMARY_KEYS.get(name, [])))
    return t.spark.createDataFrame(rows, COLUMNS_SCHEMA)


def profiled_columns(t: Tables) -> DataFrame:
    """A4 with the data's own counts: a column of a filled table without nulls reads as NOT NULL."""
    return schema_columns(t).drop("not_null").join(column_profile(t), ["table", "name"]).withColumn(
        "not_null", (F.col("n_rows") > 0) & (F.col("n_nulls") == 0))


def foreign_keys_df(spark) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(FOREIGN_KEYS)],
                                 "i int, table string, from_column string, to_table string, to_column string")


def table_ddl(cols: DataFrame) -> DataFrame:
    """A5: ``CREATE TABLE t (\\n  c type PRIMARY KEY NOT NULL,...\\n);`` per table."""
    line = F.concat(F.lit("  "), "name", F.lit(" "), "type",
                    F.when(F.col("primary_key"), F.lit(" PRIMARY KEY")).otherwise(F.lit("")),
                    F.when(F.col("not_null"), F.lit(" NOT NULL")).otherwise(F.lit("")))
    per = cols.groupBy("db_name", "table_order", "table").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("ls"))
    return per.select("db_name", "table_order", "table", F.concat(
        F.lit("CREATE TABLE "), "table", F.lit(" (\n"),
        F.array_join(F.transform("ls", lambda x: x["line"]), ",\n"), F.lit("\n);")).alias("ddl"))


def schema_text(cols: DataFrame) -> DataFrame:
    """Whole-database DDL text, tables in catalog order (one row per database)."""
    d = table_ddl(cols)
    return d.groupBy("db_name").agg(F.concat(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("table_order", "ddl"))), lambda x: x["ddl"]), "\n\n"),
        F.lit("\n")).alias("schema_text"))


def fk_check(t: Tables) -> DataFrame:
    """Every declared edge with its child row count and orphan count (anti join)."""
    out = None
    for child, fc, parent, pc in FOREIGN_KEYS:
        # a NULL key refers to nothing, so it is no orphan
        c = t[child].select(F.col(fc).alias("k")).where(F.col("k").isNotNull())
        p = t[parent].select(F.col(pc).alias("k"))
        orphans = c.join(p, "k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        total = t[child].agg(F.count(F.lit(1)).alias("child_rows"))
        row = total.crossJoin(orphans).select(
            F.lit(child).alias("table"), F.lit(fc).alias("from_column"), F.lit(parent).alias("to_table"),
            F.lit(pc).alias("to_column"), "child_rows", "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def column_value_sample(t: Tables, n: int = SAMPLE_SIZE) -> DataFrame:
    """The n smallest distinct values of every text column."""
    text = {name: (t[name], [f.name for f in t[name].schema.fields if f.dataType.simpleString() in TEXT_TYPES])
            for name in TABLE_NAMES}
    return smallest_values({name: x for name, x in text.items() if x[1]}, n)


# Tables whose rows stand in the schema context, and rows of each.
CONTEXT_TABLES, CONTEXT_ROWS = 3, 2


def schema_context(cols: DataFrame, t: Tables) -> DataFrame:
    """Schema text, ``t.c -> t2.c2`` foreign-key lines, and two sample rows of the first three tables by name."""
    fk = foreign_keys_df(t.spark)
    lines = fk.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "i", F.concat("table", F.lit("."), "from_column", F.lit(" -> "), "to_table", F.lit("."), "to_column")
        .alias("l")))), lambda x: x["l"]), "\n").alias("fk_lines"))
    shown = sorted(TABLE_NAMES)[:CONTEXT_TABLES]
    rows = sample_texts(t, {name: PRIMARY_KEYS[name] for name in shown}, CONTEXT_ROWS)
    part = F.concat(F.lit("\n\n-- "), "table", F.lit(" --\n"), F.array_join("rows", "\n"))
    samples = rows.where(F.size("rows") > 0).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "table", part.alias("part")))), lambda x: x["part"]), "").alias("samples"))
    st = schema_text(cols)
    return st.crossJoin(lines).crossJoin(samples).select("db_name", F.concat(
        F.lit("=== DATABASE SCHEMA ===\n\n"), "schema_text",
        F.lit("\n\n=== FOREIGN KEY RELATIONSHIPS ===\n\n"), "fk_lines",
        F.lit("\n\n=== SAMPLE DATA ===\n"), "samples").alias("context"))


# ---------------------------------------------------------------- registry

def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _q_scan(spark, sf_dir):
    return _t(spark, sf_dir).customer.select("*")


def _q_fetch_one(spark, sf_dir):
    return _t(spark, sf_dir).orders.orderBy("o_orderkey").limit(1).select("o_orderkey", "o_custkey", "o_totalprice")


def _q_param(spark, sf_dir):
    _t(spark, sf_dir).orders  # registers the view the statement reads
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :cust AND o_totalprice > :minp",
                     args={"cust": 7, "minp": 1000.0})


def _q_schema(spark, sf_dir):
    return profiled_columns(_t(spark, sf_dir)).select(
        "table", "ordinal", "name", "type", "not_null", "primary_key", "n_rows", "n_nulls")


def _q_ddl(spark, sf_dir):
    return table_ddl(profiled_columns(_t(spark, sf_dir))).select("table", "ddl")


def _q_fk(spark, sf_dir):
    return fk_check(_t(spark, sf_dir))


def _q_sample_rows(spark, sf_dir):
    return _t(spark, sf_dir).customer.orderBy("c_custkey").limit(3).select("c_custkey", "c_name", "c_mktsegment")


def _q_values(spark, sf_dir):
    return column_value_sample(_t(spark, sf_dir))


def _q_list(spark, sf_dir):
    """The tables there are, with their rows."""
    t = _t(spark, sf_dir)
    out = None
    for n in sorted(t.available()):
        one = t[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def _q_stats(spark, sf_dir):
    """Tables, columns, rows and values that are there."""
    p = column_profile(_t(spark, sf_dir))
    per = p.groupBy("table").agg(F.count(F.lit(1)).alias("c"), F.max("n_rows").alias("r"),
                                 F.sum(F.col("n_rows") - F.col("n_nulls")).alias("v"))
    return per.agg(F.count(F.lit(1)).alias("num_tables"), F.sum("c").alias("total_columns"),
                   F.sum("r").alias("total_rows"), F.sum("v").alias("total_values"))


def _q_ddl_names(spark, sf_dir):
    from ..functions.sqltext import ddl_table_names
    st = schema_text(profiled_columns(_t(spark, sf_dir)))
    return st.select("db_name", F.array_join(ddl_table_names("schema_text"), ",").alias("tables"))


def _q_context(spark, sf_dir):
    t = _t(spark, sf_dir)
    return schema_context(profiled_columns(t), t)


_NAMES_SQL = ", ".join(f"('{n}', {i})" for i, n in enumerate(TABLE_NAMES))
_PK_SQL = ", ".join(f"('{tb}', '{c}')" for tb, cs in PRIMARY_KEYS.items() for c in cs)
_FK_SQL = ", ".join(f"({i}, '{a}', '{b}', '{c}', '{d}')" for i, (a, b, c, d) in enumerate(FOREIGN_KEYS))
COLS_CTE = f"""
tn AS (SELECT * FROM (VALUES {_NAMES_SQL}) v(table_name, table_order)),
pk AS (SELECT * FROM (VALUES {_PK_SQL}) v(table_name, column_name)),
cols AS (
  SELECT 'tpch' AS db_name, tn.table_order, c.table_name AS "table", CAST(c.ordinal_position AS INTEGER) AS ordinal,
         c.column_name AS name,
         CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
              WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
              ELSE lower(c.data_type) END AS type,
         FALSE AS not_null, pk.column_name IS NOT NULL AS primary_key
  FROM information_schema.columns c JOIN tn ON tn.table_name = c.table_name
  LEFT JOIN pk ON pk.table_name = c.table_name AND pk.column_name = c.column_name),
ddl AS (
  SELECT db_name, table_order, "table", 'CREATE TABLE ' || "table" || ' (' || chr(10)
    || string_agg('  ' || name || ' ' || type || CASE WHEN primary_key THEN ' PRIMARY KEY' ELSE '' END
                  || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END, ',' || chr(10) ORDER BY ordinal)
    || chr(10) || ');' AS ddl
  FROM cols GROUP BY db_name, table_order, "table"),
st AS (SELECT db_name, string_agg(ddl, chr(10) || chr(10) ORDER BY table_order) || chr(10) AS schema_text FROM ddl GROUP BY db_name)"""

# The columns of the fixture tables (from FIXTURES.md).
TABLE_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
    for t, cs in TABLE_COLUMNS.items() for c in cs.split())
PROFILED_CTE = f"prof AS ({_PROFILE_SQL})," + COLS_CTE.replace(
    "FALSE AS not_null", "prof.n_rows > 0 AND prof.n_nulls = 0 AS not_null, prof.n_rows, prof.n_nulls").replace(
    "LEFT JOIN pk ON", "JOIN prof ON prof.t = c.table_name AND prof.c = c.column_name\n  LEFT JOIN pk ON")

_FK_ORACLE_PARTS = " UNION ALL ".join(
    f"SELECT '{a}' AS \"table\", '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column, "
    f"(SELECT count(*) FROM {a}) AS child_rows, "
    f"(SELECT count(*) FROM {a} x WHERE x.{b} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {c} y WHERE y.{d} = x.{b})) AS orphans"
    for a, b, c, d in FOREIGN_KEYS)

# The text columns of the fixture tables (from FIXTURES.md).
TEXT_COLUMNS = [
    ("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("customer", "c_mktsegment"),
    ("supplier", "s_name"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"),
    ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"),
    ("lineitem", "l_linestatus"), ("events", "event_type"), ("events", "props"), ("documents", "text"),
    ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"),
    ("benchmark", "text"), ("conversations", "role"), ("conversations", "text"),
]
_VALUES_UNION = " UNION ".join(
    f"SELECT '{tb}' AS \"table\", '{col}' AS \"column\", {col} AS value FROM {tb}" for tb, col in TEXT_COLUMNS)

# Columns of the fixture tables with fractions, times and lists (from FIXTURES.md).
FLOAT_COLUMNS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "value")
TIME_COLUMNS = ("o_orderdate", "l_shipdate", "ts")
LIST_COLUMNS = ("embedding",)


def _number_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(CAST(CAST(round(CAST({x} AS DOUBLE), 6) AS DECIMAL(38, 6)) AS VARCHAR), "
            r"'0+$', ''), '\.$', '.0')")


def _quoted_sql(c: str) -> str:
    x = c
    for raw, shown in ((92, "chr(92)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        x = f"replace({x}, chr({raw}), chr(92) || {shown})"
    return (f"CASE WHEN instr({c}, chr(39)) = 0 THEN chr(39) || {x} || chr(39) "
            f"WHEN instr({c}, chr(34)) = 0 THEN chr(34) || {x} || chr(34) "
            f"ELSE chr(39) || replace({x}, chr(39), chr(92) || chr(39)) || chr(39) END")


def _value_sql(table: str, c: str) -> str:
    if c in LIST_COLUMNS:
        body = f"'[' || array_to_string(list_transform({c}, lambda x: {_number_sql('x')}), ', ') || ']'"
    elif c in FLOAT_COLUMNS:
        body = _number_sql(c)
    elif c in TIME_COLUMNS:
        body = f"chr(39) || strftime({c}, '%Y-%m-%d %H:%M:%S') || chr(39)"
    else:
        body = _quoted_sql(c) if (table, c) in TEXT_COLUMNS else f"CAST({c} AS VARCHAR)"
    return f"coalesce({body}, 'None')"


def rows_sql(table: str, n: int) -> str:
    """DuckDB SQL: (table, r, row_text) of the first ``n`` rows by key."""
    text = " || ', ' || ".join(f"chr(39) || '{c}' || chr(39) || ': ' || {_value_sql(table, c)}"
                               for c in TABLE_COLUMNS[table].split())
    key = PRIMARY_KEYS[table]
    there = " AND ".join(f"{k} IS NOT NULL" for k in key)
    return (f"SELECT * FROM (SELECT '{table}' AS \"table\", row_number() OVER (ORDER BY {', '.join(key)}, row_text) AS r, "
            f"row_text FROM (SELECT *, '{{' || {text} || '}}' AS row_text FROM {table} WHERE {there}) x) y WHERE r <= {n}")


_CONTEXT_ROWS_SQL = " UNION ALL ".join(rows_sql(n, CONTEXT_ROWS) for n in sorted(TABLE_NAMES)[:CONTEXT_TABLES])


ORACLES = {
    "scan_table": "SELECT * FROM customer",
    "fetch_one": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1",
    "param_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0",
    "schema_extract": "WITH " + PROFILED_CTE + '\nSELECT "table", ordinal, name, type, not_null, primary_key, n_rows, n_nulls FROM cols',
    "schema_ddl_text": "WITH " + PROFILED_CTE + '\nSELECT "table", ddl FROM ddl',
    "foreign_keys": _FK_ORACLE_PARTS,
    "sample_rows": "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 3",
    "list_databases": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES),
    "quick_stats": f"""
WITH prof AS ({_PROFILE_SQL}),
p AS (SELECT t, count(*) AS c, max(n_rows) AS r, sum(n_rows - n_nulls) AS v FROM prof GROUP BY t)
SELECT count(*) AS num_tables, CAST(sum(c) AS BIGINT) AS total_columns, CAST(sum(r) AS BIGINT) AS total_rows,
       CAST(sum(v) AS BIGINT) AS total_values FROM p""",
    "ddl_table_names": "WITH " + PROFILED_CTE + r"""
SELECT db_name, array_to_string(list_sort(list_distinct(regexp_extract_all(schema_text, '(?i)CREATE TABLE\s+(\w+)', 1))), ',') AS tables FROM st""",
    "schema_context_text": "WITH " + PROFILED_CTE + f""",
fk AS (SELECT * FROM (VALUES {_FK_SQL}) v(i, t, fc, tt, tc)),
shown AS (SELECT "table", chr(10) || chr(10) || '-- ' || "table" || ' --' || chr(10)
            || string_agg(row_text, chr(10) ORDER BY r) AS part FROM ({_CONTEXT_ROWS_SQL}) z GROUP BY "table")
SELECT db_name, '=== DATABASE SCHEMA ===' || chr(10) || chr(10) || schema_text || chr(10) || chr(10)
  || '=== FOREIGN KEY RELATIONSHIPS ===' || chr(10) || chr(10)
  || (SELECT string_agg(t || '.' || fc || ' -> ' || tt || '.' || tc, chr(10) ORDER BY i) FROM fk)
  || chr(10) || chr(10) || '=== SAMPLE DATA ===' || chr(10)
  || coalesce((SELECT string_agg(part, '' ORDER BY "table") FROM shown), '') AS context FROM st""",
}


ORACLES["column_value_sample"] = f"""
SELECT "table", "column", value FROM (
  SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY value) AS rn FROM ({_VALUES_UNION}) u
  WHERE value IS NOT NULL) z WHERE rn <= {SAMPLE_SIZE}"""


QUERIES = {
    "scan_table": _q_scan,
    "fetch_one": _q_fetch_one,
    "param_query": _q_param,
    "schema_extract": _q_schema,
    "schema_ddl_text": _q_ddl,
    "foreign_keys": _q_fk,
    "sample_rows": _q_sample_rows,
    "column_value_sample": _q_values,
    "list_databases": _q_list,
    "quick_stats": _q_stats,
    "ddl_table_names": _q_ddl_names,
    "schema_context_text": _q_context,
}
