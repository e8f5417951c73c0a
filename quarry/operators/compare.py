"""Generated vs gold result sets, for every question in one job.

Input is a long table ``(side, question, row)`` holding the generated
(``side='gen'``) and gold (``side='gold'``) rows of all questions.  Every
question has columns of its own, so a row is an array of (name, VARIANT);
``packed`` makes one from columns, and each comparison also takes a list of
column names where all questions share them.  Every comparison reduces to one
kernel: group by ``(question, row key)`` counting the rows of each side (one
shuffle, with map-side partial aggregation), then group by question.  A
question whose result has a billion rows is spread over all tasks by its row
keys - no question is ever collected into one task or onto the driver.

Values: D1 compares texts, as it is defined on stringified values (1 and 1.0
differ, 1 and '1' do not).  D2-D5 compare values by type: numbers and booleans
by value whatever their types (1 equals 1.0 and true), text with text only,
NULL with NULL only; dates and timestamps count as text.  Numbers with
fractions, or of 1e18 and more, compare as doubles unless they are integers.
A result without a column differs from one that has it, NULL or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import normalize_sql
from .ordinal import with_ordinal

SEP = "\u0001"
ROW = "array<struct<name:string,value:variant>>"


def packed(columns: dict[str, Column]) -> Column:
    """A result row: (name, VARIANT) of each column, in column order."""
    cells = [F.struct(F.lit(n).alias("name"), v.cast("variant").alias("value")) for n, v in columns.items()]
    return F.array(*cells).cast(ROW) if cells else F.array().cast(ROW)


def _row(cols: list[str] | str) -> Column:
    return F.col(cols) if isinstance(cols, str) else packed({x: F.col(x) for x in cols})


def _json(cols: list[str] | str) -> Column:
    """(name, json) of a row's cells: text is quoted there, numbers are not."""
    return F.transform(_row(cols), lambda x: F.struct(x["name"].alias("name"), F.to_json(x["value"]).alias("json")))


def value_text(j: Column) -> Column:
    """The JSON of a typed value as text that is the same for equal values."""
    d = j.cast("double")
    whole = (F.abs(d) < 1e18) & (d == F.floor(d))
    return (F.when(j.isNull() | (j == "null"), F.lit("null")).when(j.startswith('"'), j)
            .when(~j.contains(".") & ~j.contains("E"), F.when(j == "true", "1").when(j == "false", "0").otherwise(j))
            .when(j.endswith(".0") & (j != "-0.0"), F.substr(j, F.lit(1), F.length(j) - 2))
            .when(whole, d.cast("decimal(38,0)").cast("string")).otherwise(d.cast("string")))


def set_key(cols: list[str] | str) -> Column:
    """D1 row key: the row's values as text ('None' for NULL), sorted."""
    text = F.transform(_row(cols), lambda x: F.coalesce(x["value"].cast("string"), F.lit("None")))
    return F.array_join(F.sort_array(text), SEP)


def named_key(cols: list[str] | str) -> Column:
    """D2-D4 row key: sorted (column name, value) pairs."""
    pairs = F.transform(_json(cols), lambda x: F.concat(x["name"], F.lit("="), value_text(x["json"])))
    return F.array_join(F.sort_array(pairs), SEP)


def value_key(cols: list[str] | str) -> Column:
    """D5 row key: values in column order."""
    return F.array_join(F.transform(_json(cols), lambda x: value_text(x["json"])), SEP)


def side_counts(rows: DataFrame, key: Column, question: str = "question", side: str = "side") -> DataFrame:
    """Per question: set sizes, intersection, row counts and bag differences."""
    per_key = (rows.select(F.col(question).alias("question"), key.alias("k"), F.col(side).alias("side"))
               .groupBy("question", "k")
               .agg(F.sum(F.when(F.col("side") == "gen", 1).otherwise(0)).alias("ng"),
                    F.sum(F.when(F.col("side") == "gold", 1).otherwise(0)).alias("no")))
    return per_key.groupBy("question").agg(
        F.count(F.when(F.col("ng") > 0, 1)).alias("gen_set"),
        F.count(F.when(F.col("no") > 0, 1)).alias("gold_set"),
        F.count(F.when((F.col("ng") > 0) & (F.col("no") > 0), 1)).alias("both_set"),
        F.sum("ng").alias("gen_rows"),
        F.sum("no").alias("gold_rows"),
        F.count(F.when(F.col("ng") != F.col("no"), 1)).alias("bag_diff"))


def _with_universe(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with no row on either side still get a (zero) row."""
    zero = ["gen_set", "gold_set", "both_set", "gen_rows", "gold_rows", "bag_diff"]
    out = questions.select(F.col(questions.columns[0]).alias("question")).join(stats, "question", "left")
    return out.select("question", *[F.coalesce(F.col(z), F.lit(0)).cast("long").alias(z) for z in zero])


def exact_set_match(rows: DataFrame, cols: list[str] | str, questions: DataFrame) -> DataFrame:
    """Set of sorted stringified rows equal; both empty -> true, one empty -> false."""
    s = _with_universe(side_counts(rows, set_key(cols)), questions)
    both_empty = (F.col("gen_rows") == 0) & (F.col("gold_rows") == 0)
    nonempty = (F.col("gen_rows") > 0) & (F.col("gold_rows") > 0)
    same = (F.col("gen_set") == F.col("both_set")) & (F.col("gold_set") == F.col("both_set"))
    return s.select("question", (both_empty | (nonempty & same)).alias("exact_set_match"))


def multiset_match(rows: DataFrame, cols: list[str] | str, questions: DataFrame) -> DataFrame:
    """Equal length and equal bag of rows; both empty -> true."""
    s = _with_universe(side_counts(rows, named_key(cols)), questions)
    both_empty = (F.col("gen_rows") == 0) & (F.col("gold_rows") == 0)
    nonempty = (F.col("gen_rows") > 0) & (F.col("gold_rows") > 0)
    bag = (F.col("gen_rows") == F.col("gold_rows")) & (F.col("bag_diff") == 0)
    return s.select("question", (both_empty | (nonempty & bag)).alias("multiset_match"))


def jaccard_match(rows: DataFrame, cols: list[str] | str, questions: DataFrame) -> DataFrame:
    """D3: set equality, Jaccard of row sets, both row counts."""
    s = _with_universe(side_counts(rows, named_key(cols)), questions)
    same = (F.col("gen_set") == F.col("both_set")) & (F.col("gold_set") == F.col("both_set"))
    nonempty = (F.col("gen_set") > 0) & (F.col("gold_set") > 0)
    jac = F.when(nonempty, F.col("both_set") / (F.col("gen_set") + F.col("gold_set") - F.col("both_set"))) \
        .otherwise(F.when(same, 1.0).otherwise(0.0))
    return s.select("question", same.alias("exact_match"), F.round(jac, 6).alias("jaccard"),
                    F.col("gen_rows").alias("result1_count"), F.col("gold_rows").alias("result2_count"))


def overlap_prf(rows: DataFrame, cols: list[str] | str, questions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Bag equality, then precision / recall / F1 over row sets.

    With ``texts`` (question, gen_sql, gold_sql) also whether the normalized
    statements are equal; a question without texts has none.
    """
    s = _with_universe(side_counts(rows, named_key(cols)), questions)
    both = (F.col("gen_rows") > 0) & (F.col("gold_rows") > 0)
    none = (F.col("gen_rows") == 0) & (F.col("gold_rows") == 0)
    p = F.col("both_set") / F.col("gen_set")
    r = F.col("both_set") / F.col("gold_set")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    fallback = F.when(none, 1.0).otherwise(0.0)
    out = s.select(
        "question",
        ((F.col("gen_rows") == F.col("gold_rows")) & (F.col("bag_diff") == 0)).alias("execution_match"),
        F.round(F.when(both, p).otherwise(fallback), 6).alias("precision"),
        F.round(F.when(both, r).otherwise(fallback), 6).alias("recall"),
        F.round(F.when(both, f1).otherwise(fallback), 6).alias("f1"))
    if texts is None:
        return out
    same = texts.select("question", (normalize_sql("gen_sql") == normalize_sql("gold_sql")).alias("exact_sql_match"))
    return out.join(same, "question", "left")


def ordered_match(rows: DataFrame, cols: list[str] | str, order: list[str], questions: DataFrame) -> DataFrame:
    """Same rows in the same order, by values and by names with values; an empty side never matches.

    Counts and an order-free hash settle most questions; only rows of the
    questions still open are numbered.
    """
    keyed = rows.select("side", "question", F.unhex(F.md5(value_key(cols))).alias("k"),
                        F.unhex(F.md5(named_key(cols))).alias("nk"), *order)
    gen, gold = F.col("side") == "gen", F.col("side") == "gold"
    def total(side, key):
        return F.sum(F.when(side, F.xxhash64(key).cast("decimal(38,0)")))
    alike = keyed.groupBy("question").agg(
        F.count(F.when(gen, 1)).alias("ng"), F.count(F.when(gold, 1)).alias("no"),
        (total(gen, "k") == total(gold, "k")).alias("values"), (total(gen, "nk") == total(gold, "nk")).alias("named"))
    open_ = alike.where((F.col("ng") > 0) & (F.col("ng") == F.col("no")) & (F.col("values") | F.col("named"))).select("question")
    # both sides numbered in one pass (one range shuffle, one written copy)
    numbered = with_ordinal(keyed.join(open_, "question", "left_semi"), ["side", "question"], order)
    g = numbered.filter(gen).select("question", "ord", F.col("k").alias("kg"), F.col("nk").alias("nkg"))
    o = numbered.filter(gold).select("question", "ord", F.col("k").alias("ko"), F.col("nk").alias("nko"))
    per_q = g.join(o, ["question", "ord"], "full_outer").groupBy("question").agg(
        F.bool_and(F.coalesce(F.col("kg") == F.col("ko"), F.lit(False))).alias("v"),
        F.bool_and(F.coalesce(F.col("nkg") == F.col("nko"), F.lit(False))).alias("n"))
    out = questions.select(F.col(questions.columns[0]).alias("question")).join(per_q, "question", "left")
    return out.select("question", F.coalesce("v", F.lit(False)).alias("ordered_match"),
                      F.coalesce("n", F.lit(False)).alias("ordered_named_match"))


# ---------------------------------------------------------------- registry

def _inputs(spark, sf_dir):
    from ..plans.derived import result_shapes
    from ..session import Tables
    t = Tables(spark, sf_dir)
    return result_shapes(t), t.supplier.select("s_suppkey")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"]


def _q(fn, *extra):
    def run(spark, sf_dir):
        rows, qs = _inputs(spark, sf_dir)
        return fn(rows, "row", *extra, qs)
    run.__doc__ = fn.__doc__
    return run


def _q_overlap(spark, sf_dir):
    """D4 with the statement texts of the question of the same number."""
    from ..plans.derived import query_log
    from ..session import Tables
    rows, qs = _inputs(spark, sf_dir)
    log = query_log(Tables(spark, sf_dir)).select(F.col("qid").alias("question"), "gen_sql", "gold_sql")
    return overlap_prf(rows, "row", qs, log.join(
        qs.select(F.col("s_suppkey").alias("question")), "question", "left_semi"))


def _by_shape(side: str, shape: int, cells: list[str]) -> str:
    return f"WHEN side = '{side}' AND shape = {shape} THEN [{', '.join(cells)}]"


def _oracle_prefix():
    """Row keys written out for every shape of result: names, texts (D1) and typed values."""
    from ..plans.derived import RESULT_SHAPES_SQL
    p, q, whole = "CAST(l_partkey AS VARCHAR)", "CAST(l_quantity AS VARCHAR)", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
    disc = "CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END"
    names = ["'l_partkey'", "'l_quantity'"]
    return f"""WITH rs AS ({RESULT_SHAPES_SQL}), cells AS (SELECT *,
  CASE {_by_shape("gen", 1, ["'part'", "'qty'"])} {_by_shape("gold", 2, [*names, "'l_discount'"])}
       {_by_shape("gen", 5, names[::-1])} ELSE [{", ".join(names)}] END AS names,
  CASE {_by_shape("gold", 2, [p, q, "CAST(l_discount AS VARCHAR)"])} {_by_shape("gold", 3, [p, whole])}
       {_by_shape("gen", 5, [q, p])} ELSE [{p}, {q}] END AS texts,
  CASE {_by_shape("gold", 2, [p, whole, disc])} {_by_shape("gen", 4, [f"chr(34) || {p} || chr(34)", whole])}
       {_by_shape("gen", 5, [whole, p])} ELSE [{p}, {whole}] END AS typed FROM rs),
rr AS (SELECT side, question, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, array_to_string(list_sort(texts), chr(1)) AS set_key,
  array_to_string(list_sort(list_transform(range(1, len(names) + 1), lambda i: names[i] || '=' || typed[i])), chr(1)) AS named_key,
  array_to_string(typed, chr(1)) AS value_key FROM cells),
qs AS (SELECT s_suppkey AS question FROM supplier)
"""


def _stats_sql(key: str) -> str:
    return f"""
, pk AS (SELECT question, {key} AS k, sum(CASE WHEN side = 'gen' THEN 1 ELSE 0 END) AS ng,
                sum(CASE WHEN side = 'gold' THEN 1 ELSE 0 END) AS no FROM rr GROUP BY question, k),
st0 AS (SELECT question, count(*) FILTER (WHERE ng > 0) AS gen_set, count(*) FILTER (WHERE no > 0) AS gold_set,
               count(*) FILTER (WHERE ng > 0 AND no > 0) AS both_set, sum(ng) AS gen_rows, sum(no) AS gold_rows,
               count(*) FILTER (WHERE ng <> no) AS bag_diff FROM pk GROUP BY question),
st AS (SELECT qs.question, coalesce(gen_set, 0) AS gen_set, coalesce(gold_set, 0) AS gold_set,
              coalesce(both_set, 0) AS both_set, CAST(coalesce(gen_rows, 0) AS BIGINT) AS gen_rows,
              CAST(coalesce(gold_rows, 0) AS BIGINT) AS gold_rows, coalesce(bag_diff, 0) AS bag_diff
       FROM qs LEFT JOIN st0 USING (question))
"""


from ..plans import duck as D  # noqa: E402
from ..plans.derived import QUERY_LOG_SQL  # noqa: E402

ORACLES = {
    "exact_set_match": _oracle_prefix() + _stats_sql("set_key") + """
SELECT question, (gen_rows = 0 AND gold_rows = 0)
  OR (gen_rows > 0 AND gold_rows > 0 AND gen_set = both_set AND gold_set = both_set) AS exact_set_match FROM st""",
    "multiset_match": _oracle_prefix() + _stats_sql("named_key") + """
SELECT question, (gen_rows = 0 AND gold_rows = 0)
  OR (gen_rows > 0 AND gold_rows > 0 AND gen_rows = gold_rows AND bag_diff = 0) AS multiset_match FROM st""",
    "jaccard_match": _oracle_prefix() + _stats_sql("named_key") + """
SELECT question, gen_set = both_set AND gold_set = both_set AS exact_match,
  round(CASE WHEN gen_set > 0 AND gold_set > 0 THEN both_set / (gen_set + gold_set - both_set)
             WHEN gen_set = both_set AND gold_set = both_set THEN 1.0 ELSE 0.0 END, 6) AS jaccard,
  gen_rows AS result1_count, gold_rows AS result2_count FROM st""",
    "overlap_prf": _oracle_prefix() + _stats_sql("named_key") + f""",
query_log AS ({QUERY_LOG_SQL}),
tx AS (SELECT qid, {D.normalize_sql('gen_sql')} = {D.normalize_sql('gold_sql')} AS exact_sql_match FROM query_log)
SELECT question, exact_sql_match, gen_rows = gold_rows AND bag_diff = 0 AS execution_match,
  round(CASE WHEN gen_rows > 0 AND gold_rows > 0 THEN p WHEN gen_rows = 0 AND gold_rows = 0 THEN 1.0 ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN gen_rows > 0 AND gold_rows > 0 THEN r WHEN gen_rows = 0 AND gold_rows = 0 THEN 1.0 ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN gen_rows > 0 AND gold_rows > 0 THEN (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END)
             WHEN gen_rows = 0 AND gold_rows = 0 THEN 1.0 ELSE 0.0 END, 6) AS f1
FROM (SELECT *, both_set / gen_set AS p, both_set / gold_set AS r FROM st) z LEFT JOIN tx ON qid = question""",
    "ordered_match": _oracle_prefix() + """
, o AS (SELECT side, question, value_key AS k, named_key AS nk,
               row_number() OVER (PARTITION BY side, question ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) AS ord FROM rr),
j AS (SELECT coalesce(g.question, d.question) AS question, g.k AS kg, d.k AS ko, g.nk AS nkg, d.nk AS nko
      FROM (SELECT * FROM o WHERE side = 'gen') g
      FULL OUTER JOIN (SELECT * FROM o WHERE side = 'gold') d ON g.question = d.question AND g.ord = d.ord),
pq AS (SELECT question, bool_and(coalesce(kg = ko, false)) AS v, bool_and(coalesce(nkg = nko, false)) AS n FROM j GROUP BY question)
SELECT qs.question, coalesce(v, false) AS ordered_match, coalesce(n, false) AS ordered_named_match
FROM qs LEFT JOIN pq USING (question)""",
}

QUERIES = {
    "exact_set_match": _q(exact_set_match),
    "multiset_match": _q(multiset_match),
    "jaccard_match": _q(jaccard_match),
    "overlap_prf": _q_overlap,
    "ordered_match": _q(ordered_match, ORDER),
}
