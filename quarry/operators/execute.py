"""Run generated and gold SQL, then compare every result set in one job.

The driver only *plans* one DataFrame per distinct SQL text (``spark.sql``
parses and analyses eagerly, so bad SQL fails here and is captured as text,
never raised).  No result is collected: each planned result is turned into
the long form ``(question, side, row key)`` and all of them are unioned and
compared by the set-comparison kernel in a single distributed job.
The union is materialized once (a reliable checkpoint); when a statement
fails at run time (e.g. an ANSI cast error), the statements are materialized
one by one instead, so the failing ones are reported with their error and the
others are still compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import semantic_similar, component_match_df, read_only_guard
from .compare import _with_universe, set_key, side_counts


def plan_sql(spark: SparkSession, sql: str):
    """(DataFrame or None, error text or None)."""
    try:
        return spark.sql(sql), None
    except Exception as e:  # AnalysisException, ParseException, ...
        return None, f"{type(e).__name__}: {str(e).strip()}"


def _materialize(parts: list[tuple[int, DataFrame]]):
    """(materialized union or None, {question: run-time error}) - errors are captured, not raised."""
    from ..session import cut_lineage
    if not parts:
        return None, {}
    union = parts[0][1]
    for _, p in parts[1:]:
        union = union.unionByName(p)
    try:
        return cut_lineage(union), {}
    except Exception:
        ok, errors = [], {}
        for q, p in parts:
            if q in errors:
                continue
            try:
                ok.append(cut_lineage(p))
            except Exception as e:  # run-time failure of this statement only
                errors[q] = f"{type(e).__name__}: {str(e).strip()}"
        ok = [d for d in ok]
        if not ok:
            return None, errors
        u = ok[0]
        for d in ok[1:]:
            u = u.unionByName(d)
        return u, errors


def _long_form(df: DataFrame, question, side: str) -> DataFrame:
    cols = df.columns
    renamed = df.toDF(*[f"c{i}" for i in range(len(cols))])
    return renamed.select(F.lit(question).cast("long").alias("question"), F.lit(side).alias("side"),
                          set_key([f"c{i}" for i in range(len(cols))]).alias("k"))


def execution_accuracy(spark: SparkSession, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """(question, valid, correct, error) for (question, generated SQL, gold SQL) triples."""
    status, parts = {}, []
    for q, gen, gold in pairs:
        gdf, gerr = plan_sql(spark, gold)
        if gdf is None:
            status[q] = (False, f"Database error: {gerr}")
            continue
        df, err = plan_sql(spark, gen)
        parts.append((q, _long_form(gdf, q, "gold")))
        if df is None:
            status[q] = (False, f"Generated SQL error: {err}")
            continue
        parts.append((q, _long_form(df, q, "gen")))
        status[q] = (True, None)
    rows, run_errors = _materialize(parts)
    for q, err in run_errors.items():
        status[q] = (False, f"Execution error: {err}")
    st = spark.createDataFrame([(q, v, e) for q, (v, e) in status.items()],
                               "question long, valid boolean, error string")
    if rows is None:
        return st.select("question", "valid", F.lit(False).alias("correct"), "error")
    rows = rows.join(st.filter("valid").select("question"), "question", "left_semi")
    stats = _with_universe(side_counts(rows, F.col("k")), st.select("question"))
    both_empty = (F.col("gen_rows") == 0) & (F.col("gold_rows") == 0)
    nonempty = (F.col("gen_rows") > 0) & (F.col("gold_rows") > 0)
    same = (F.col("gen_set") == F.col("both_set")) & (F.col("gold_set") == F.col("both_set"))
    match = stats.select("question", (both_empty | (nonempty & same)).alias("m"))
    return (st.join(match, "question", "left")
            .select("question", "valid", (F.col("valid") & F.coalesce("m", F.lit(False))).alias("correct"), "error"))


def full_evaluation(spark: SparkSession, pairs) -> DataFrame:
    """D6 outcome + component match (C19) + statement/table similarity (C8) per question."""
    ex = execution_accuracy(spark, pairs)
    texts = spark.createDataFrame(pairs, "question long, gen string, gold string")
    cm = component_match_df(texts, "gen", "gold")
    sim = semantic_similar("gen", "gold")
    feats = cm.select("question", "component_score", sim.alias("semantic_similar"))
    return ex.join(feats, "question").select(
        "question", F.col("valid").alias("execution_valid"), F.col("correct").alias("execution_correct"),
        F.round("component_score", 6).alias("component_score"), "semantic_similar")


def guarded_execute(spark: SparkSession, items: list[tuple[int, str]]) -> DataFrame:
    """Gate (empty / non-SELECT refused), plan, and count rows of every allowed statement."""
    texts = spark.createDataFrame(items, "question long, sql string")
    gate = texts.select("question", "sql", read_only_guard("sql").alias("g")).collect()  # one row per statement
    status, parts = {}, []
    for r in gate:
        q = r["question"]
        if r["sql"] is None or r["sql"].strip() == "":
            status[q] = (False, "No SQL query to execute")
        elif not r["g"]["allowed"]:
            status[q] = (False, r["g"]["error"])
        else:
            df, err = plan_sql(spark, r["sql"])
            if df is None:
                status[q] = (False, f"Execution error: {err}")
            else:
                status[q] = (True, None)
                # hash every column so the statement really runs (a bare count
                # would let the optimizer prune the projection and skip errors)
                h = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit(0)
                # ``_h`` stays in the materialized rows, so it cannot be pruned away
                parts.append((q, df.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), h.cast("long").alias("_h"))
                              .select(F.lit(q).cast("long").alias("question"), "n_rows", "_h")))
    rows, run_errors = _materialize(parts)
    for q, err in run_errors.items():
        status[q] = (False, f"Execution error: {err}")
    st = spark.createDataFrame([(q, v, e) for q, (v, e) in status.items()],
                               "question long, success boolean, error string")
    if rows is None:
        return st.withColumn("n_rows", F.lit(0).cast("long")).select(
            "question", "success", "n_rows", F.coalesce("error", F.lit("")).alias("error"))
    counts = rows.groupBy("question").agg(F.sum("n_rows").alias("n_rows"))
    return st.join(counts, "question", "left").select(
        "question", "success", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce("error", F.lit("")).alias("error"))
