"""Evaluation aggregation and report tables.

All of them are group-bys over the long per-(question, pipeline) outcome
table; wide report shapes come from ``pivot`` / ``unpivot`` /
``groupingSets`` / ``rollup`` on already-aggregated (tiny) tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import hardness as hardness_of
from ..operators.ordinal import with_ordinal
from . import duck as D
from .derived import EVAL_RESULTS_SQL, PIPELINES, QUERY_LOG_SQL, eval_results, query_log
from .reg import Registry

R = Registry()
c = F.col

FLAGS = ["select_match", "from_match", "where_match", "groupby_match", "orderby_match"]
# Report thresholds and defaults.
BANDS = ((0.7, "success"), (0.5, "warning"))
STRATA = (("easy", 10), ("medium", 10), ("hard", 10), ("extra", 5))
RETRY_CAP = 3
SAMPLE_SEED = "42"


def _order_col() -> F.Column:
    out = F.lit(len(PIPELINES))
    for i, p in reversed(list(enumerate(PIPELINES))):
        out = F.when(c("pipeline") == p, F.lit(i)).otherwise(out)
    return out


def scored(er: DataFrame) -> DataFrame:
    """Per-row outcome flags; a run without SQL counts with all-false flags."""
    ok = c("generated_sql") != ""
    cols = {x: (ok & c(x)) for x in ["valid", "correct", "exact_set_match"] + FLAGS}
    comp = sum(F.when(ok & c(x), 1).otherwise(0) for x in FLAGS) / 5.0
    texts = [x for x in ("gold_sql", "error") if x in er.columns]
    return er.select("db_id", "id", "pipeline", "hardness", "execution_time", "generated_sql", "question", *texts,
                     *[v.alias(k) for k, v in cols.items()], comp.alias("component_score"))


def _rate(x):
    return F.avg(F.col(x).cast("double"))


def pipeline_summary(er: DataFrame, keys=("db_id", "pipeline")) -> DataFrame:
    """F1."""
    s = scored(er)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_questions"),
        _rate("valid").alias("execution_valid_rate"),
        _rate("correct").alias("execution_accuracy"),
        _rate("exact_set_match").alias("exact_set_match_rate"),
        F.avg("component_score").alias("avg_component_score"),
        *[_rate(x).alias(x + "_rate") for x in FLAGS],
        F.avg("execution_time").alias("avg_time_per_question"),
        F.sum("execution_time").alias("total_time"))


def _round_all(df: DataFrame, keep) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.name in keep or f.dataType.typeName() != "double":
            out.append(c(f.name))
        else:
            out.append(F.round(c(f.name), 6).alias(f.name))
    return df.select(*out)


def by_hardness(er: DataFrame) -> DataFrame:
    """total / correct / accuracy for easy and medium per DB and pipeline."""
    s = scored(er)
    p = (s.groupBy("db_id", "pipeline").pivot("hardness", ["easy", "medium"])
         .agg(F.count(F.lit(1)).alias("total"), F.sum(c("correct").cast("int")).alias("correct")))
    out = [c("db_id"), c("pipeline")]
    for h in ("easy", "medium"):
        tot = F.coalesce(c(f"{h}_total"), F.lit(0)).cast("long")
        cor = F.coalesce(c(f"{h}_correct"), F.lit(0)).cast("long")
        out += [tot.alias(f"{h}_total"), cor.alias(f"{h}_correct"),
                F.round(F.when(tot > 0, cor / tot).otherwise(0.0), 6).alias(f"{h}_accuracy")]
    return p.select(*out)


def combined_totals(er: DataFrame) -> DataFrame:
    """per (DB, pipeline) rows plus all-DB totals per pipeline, via grouping sets."""
    s = scored(er)
    g = s.groupingSets([["db_id", "pipeline"], ["pipeline"]], "db_id", "pipeline").agg(
        F.count(F.lit(1)).alias("total"), F.sum(c("correct").cast("int")).alias("correct"),
        F.avg("execution_time").alias("avg_time"), F.grouping_id().alias("gid"))
    return g.select(F.when(c("gid") == 0, c("db_id")).otherwise(F.lit("ALL DATABASES")).alias("database"),
                    "pipeline", c("total").cast("long").alias("total"), c("correct").cast("long").alias("correct"),
                    F.round(c("correct") / c("total"), 6).alias("accuracy"), F.round("avg_time", 6).alias("avg_time"))


def accuracy_table(er: DataFrame) -> DataFrame:
    s = scored(er)
    return s.groupBy("db_id", "pipeline").agg(_rate("correct").alias("acc"), F.avg("execution_time").alias("t"))


# ------------------------------------------------------------------ registry (eval_results)
ER = f"WITH er AS ({EVAL_RESULTS_SQL}),\n" + """sc AS (
  SELECT db_id, id, pipeline, hardness, execution_time, generated_sql, question,
    generated_sql <> '' AND valid AS valid, generated_sql <> '' AND correct AS correct,
    generated_sql <> '' AND exact_set_match AS exact_set_match,
    generated_sql <> '' AND select_match AS select_match, generated_sql <> '' AND from_match AS from_match,
    generated_sql <> '' AND where_match AS where_match, generated_sql <> '' AND groupby_match AS groupby_match,
    generated_sql <> '' AND orderby_match AS orderby_match,
    CASE WHEN generated_sql <> '' THEN (CAST(select_match AS INT) + CAST(from_match AS INT) + CAST(where_match AS INT)
      + CAST(groupby_match AS INT) + CAST(orderby_match AS INT)) / 5.0 ELSE 0.0 END AS component_score,
    CASE pipeline WHEN 'Single_Agent' THEN 0 WHEN 'Multi_Agent' THEN 1 ELSE 2 END AS porder
  FROM er)
"""

_F1_COLS = """count(*) AS total_questions, round(avg(CAST(valid AS DOUBLE)), 6) AS execution_valid_rate,
  round(avg(CAST(correct AS DOUBLE)), 6) AS execution_accuracy, round(avg(CAST(exact_set_match AS DOUBLE)), 6) AS exact_set_match_rate,
  round(avg(component_score), 6) AS avg_component_score,
  round(avg(CAST(select_match AS DOUBLE)), 6) AS select_match_rate, round(avg(CAST(from_match AS DOUBLE)), 6) AS from_match_rate,
  round(avg(CAST(where_match AS DOUBLE)), 6) AS where_match_rate, round(avg(CAST(groupby_match AS DOUBLE)), 6) AS groupby_match_rate,
  round(avg(CAST(orderby_match AS DOUBLE)), 6) AS orderby_match_rate,
  round(avg(execution_time), 6) AS avg_time_per_question, round(sum(execution_time), 6) AS total_time"""


@R.query("pipeline_summary", ER + f"SELECT db_id, pipeline, {_F1_COLS} FROM sc GROUP BY db_id, pipeline")
def q_pipeline_summary(t):
    return _round_all(pipeline_summary(eval_results(t)), ())


@R.query("by_hardness", ER + """
SELECT db_id, pipeline,
  count(*) FILTER (WHERE hardness = 'easy') AS easy_total,
  count(*) FILTER (WHERE hardness = 'easy' AND correct) AS easy_correct,
  round(CASE WHEN count(*) FILTER (WHERE hardness = 'easy') > 0 THEN count(*) FILTER (WHERE hardness = 'easy' AND correct)
        / count(*) FILTER (WHERE hardness = 'easy') ELSE 0.0 END, 6) AS easy_accuracy,
  count(*) FILTER (WHERE hardness = 'medium') AS medium_total,
  count(*) FILTER (WHERE hardness = 'medium' AND correct) AS medium_correct,
  round(CASE WHEN count(*) FILTER (WHERE hardness = 'medium') > 0 THEN count(*) FILTER (WHERE hardness = 'medium' AND correct)
        / count(*) FILTER (WHERE hardness = 'medium') ELSE 0.0 END, 6) AS medium_accuracy
FROM sc GROUP BY db_id, pipeline""")
def q_by_hardness(t):
    return by_hardness(eval_results(t))


@R.query("pipeline_metrics", ER + """
SELECT pipeline, round(avg(CAST(correct AS DOUBLE)), 6) AS execution_accuracy,
  round(avg(CAST(valid AS DOUBLE)), 6) AS validity_rate, round(avg(component_score), 6) AS avg_score,
  round(avg(execution_time), 6) AS avg_time, count(*) FILTER (WHERE valid) AS success_count
FROM sc GROUP BY pipeline""")
def q_pipeline_metrics(t):
    s = scored(eval_results(t))
    return s.groupBy("pipeline").agg(
        F.round(_rate("correct"), 6).alias("execution_accuracy"), F.round(_rate("valid"), 6).alias("validity_rate"),
        F.round(F.avg("component_score"), 6).alias("avg_score"), F.round(F.avg("execution_time"), 6).alias("avg_time"),
        F.count(F.when(c("valid"), 1)).alias("success_count"))


@R.query("single_accuracy", ER + """
SELECT round(avg(CASE WHEN valid AND correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN valid AND correct THEN 1.0 ELSE 0.0 END), 6) AS execution_match,
  count(*) AS total, count(*) FILTER (WHERE valid AND correct) AS correct
FROM sc WHERE pipeline = 'Single_Agent'""")
def q_single_accuracy(t):
    s = scored(eval_results(t)).filter(c("pipeline") == "Single_Agent")
    hit = F.when(c("valid") & c("correct"), 1.0).otherwise(0.0)
    return s.agg(F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(hit), 6).alias("execution_match"),
                 F.count(F.lit(1)).alias("total"), F.count(F.when(c("valid") & c("correct"), 1)).alias("correct"))


@R.query("batch_summary", ER + """
SELECT pipeline, count(*) FILTER (WHERE valid) AS success_count,
  round(100.0 * count(*) FILTER (WHERE valid) / count(*), 6) AS success_pct,
  round(avg(component_score), 6) AS avg_score, round(avg(execution_time), 6) AS avg_time
FROM sc GROUP BY pipeline""")
def q_batch_summary(t):
    s = scored(eval_results(t))
    return s.groupBy("pipeline").agg(
        F.count(F.when(c("valid"), 1)).alias("success_count"),
        F.round(100.0 * F.count(F.when(c("valid"), 1)) / F.count(F.lit(1)), 6).alias("success_pct"),
        F.round(F.avg("component_score"), 6).alias("avg_score"), F.round(F.avg("execution_time"), 6).alias("avg_time"))


@R.query("combined_totals", ER + """
SELECT CASE WHEN grouping(db_id) = 0 THEN db_id ELSE 'ALL DATABASES' END AS database, pipeline,
  count(*) AS total, count(*) FILTER (WHERE correct) AS correct,
  round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, round(avg(execution_time), 6) AS avg_time
FROM sc GROUP BY GROUPING SETS ((db_id, pipeline), (pipeline))""")
def q_combined_totals(t):
    return combined_totals(eval_results(t))


@R.query("best_pipeline", ER + """
, acc AS (SELECT db_id, pipeline, porder, avg(CAST(correct AS DOUBLE)) AS acc FROM sc GROUP BY db_id, pipeline, porder
          UNION ALL SELECT 'ALL', pipeline, porder, avg(CAST(correct AS DOUBLE)) FROM sc GROUP BY pipeline, porder)
SELECT db_id, pipeline, round(acc, 6) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY acc DESC, porder) AS rn FROM acc) z WHERE rn = 1""")
def q_best_pipeline(t):
    s = scored(eval_results(t)).withColumn("porder", _order_col())
    per_db = s.groupBy("db_id", "pipeline", "porder").agg(_rate("correct").alias("acc"))
    overall = s.groupBy("pipeline", "porder").agg(_rate("correct").alias("acc")).withColumn("db_id", F.lit("ALL"))
    acc = per_db.unionByName(overall)
    w = Window.partitionBy("db_id").orderBy(c("acc").desc(), "porder")  # <= 3 rows per window
    return (acc.withColumn("rn", F.row_number().over(w)).filter(c("rn") == 1)
            .select("db_id", "pipeline", F.round("acc", 6).alias("accuracy")))


@R.query("fastest_pipeline", ER + """
SELECT pipeline, round(t, 6) AS avg_time FROM (SELECT pipeline, porder, avg(execution_time) AS t FROM sc GROUP BY pipeline, porder)
ORDER BY t, porder LIMIT 1""")
def q_fastest_pipeline(t):
    s = scored(eval_results(t)).withColumn("porder", _order_col())
    a = s.groupBy("pipeline", "porder").agg(F.avg("execution_time").alias("t"))
    return a.orderBy("t", "porder").limit(1).select("pipeline", F.round("t", 6).alias("avg_time"))


@R.query("accuracy_matrix", ER + """
, m AS (SELECT db_id, avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Single_Agent') AS s,
               avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Multi_Agent') AS m,
               avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Multi_Agent_RAG') AS r FROM sc GROUP BY db_id)
SELECT db_id, round(s, 6) AS Single_Agent, round(m, 6) AS Multi_Agent, round(r, 6) AS Multi_Agent_RAG,
  CASE WHEN s >= m AND s >= r THEN 'Single_Agent' WHEN m >= r THEN 'Multi_Agent' ELSE 'Multi_Agent_RAG' END AS best
FROM m""")
def q_accuracy_matrix(t):
    s = scored(eval_results(t))
    p = s.groupBy("db_id").pivot("pipeline", list(PIPELINES)).agg(_rate("correct"))
    a, b, r = (c(x) for x in PIPELINES)
    best = (F.when((a >= b) & (a >= r), F.lit(PIPELINES[0])).when(b >= r, F.lit(PIPELINES[1]))
            .otherwise(F.lit(PIPELINES[2])))
    return p.select("db_id", *[F.round(c(x), 6).alias(x) for x in PIPELINES], best.alias("best"))


@R.query("component_matrix", ER + """
, r AS (SELECT pipeline, avg(CAST(select_match AS DOUBLE)) AS "SELECT", avg(CAST(from_match AS DOUBLE)) AS "FROM",
               avg(CAST(where_match AS DOUBLE)) AS "WHERE", avg(CAST(groupby_match AS DOUBLE)) AS "GROUP BY",
               avg(CAST(orderby_match AS DOUBLE)) AS "ORDER BY" FROM sc GROUP BY pipeline)
SELECT pipeline, component, round(rate, 6) AS rate
FROM (UNPIVOT r ON "SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY" INTO NAME component VALUE rate)""")
def q_component_matrix(t):
    s = scored(eval_results(t))
    names = ["SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY"]
    w = s.groupBy("pipeline").agg(*[_rate(f).alias(n) for f, n in zip(FLAGS, names)])
    u = w.unpivot(["pipeline"], names, "component", "rate")
    return u.select("pipeline", "component", F.round("rate", 6).alias("rate"))


@R.query("improvement_ratio", ER + """
, m AS (SELECT db_id, avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Single_Agent') AS s,
               avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Multi_Agent') AS m,
               avg(CAST(correct AS DOUBLE)) FILTER (WHERE pipeline = 'Multi_Agent_RAG') AS r FROM sc GROUP BY db_id)
SELECT db_id, round((m - s) / (s + 0.001), 6) AS multi_vs_single, round((r - m) / (m + 0.001), 6) AS rag_vs_norag
FROM m""")
def q_improvement_ratio(t):
    s = scored(eval_results(t))
    p = s.groupBy("db_id").pivot("pipeline", list(PIPELINES)).agg(_rate("correct"))
    a, b, r = (c(x) for x in PIPELINES)
    return p.select("db_id", F.round((b - a) / (a + 0.001), 6).alias("multi_vs_single"),
                    F.round((r - b) / (b + 0.001), 6).alias("rag_vs_norag"))


@R.query("accuracy_band", ER + """
SELECT db_id, pipeline, round(a, 6) AS accuracy,
  CASE WHEN a >= 0.7 THEN 'success' WHEN a >= 0.5 THEN 'warning' ELSE 'danger' END AS band
FROM (SELECT db_id, pipeline, avg(CAST(correct AS DOUBLE)) AS a FROM sc GROUP BY db_id, pipeline) z""")
def q_accuracy_band(t):
    a = accuracy_table(eval_results(t))
    band = F.lit("danger")
    for thr, name in reversed(BANDS):
        band = F.when(c("acc") >= thr, F.lit(name)).otherwise(band)
    return a.select("db_id", "pipeline", F.round("acc", 6).alias("accuracy"), band.alias("band"))


@R.query("compare_on_question", ER + """
SELECT id, pipeline, valid AS success, round(component_score, 6) AS score, round(execution_time, 6) AS execution_time,
  CASE WHEN length(generated_sql) > 50 THEN substr(generated_sql, 1, 50) || '...' ELSE generated_sql END AS sql_preview
FROM sc""")
def q_compare_on_question(t):
    s = scored(eval_results(t))
    sql = c("generated_sql")
    prev = F.when(F.length(sql) > 50, F.concat(sql.substr(1, 50), F.lit("..."))).otherwise(sql)
    return s.select("id", "pipeline", c("valid").alias("success"), F.round("component_score", 6).alias("score"),
                    F.round("execution_time", 6).alias("execution_time"), prev.alias("sql_preview"))


@R.query("analysis_totals", ER + """
SELECT coalesce(pipeline, 'TOTAL') AS pipeline, count(*) FILTER (WHERE correct) AS matches,
  round(sum(execution_time), 6) AS total_time, count(*) AS n
FROM sc WHERE hardness = 'easy' GROUP BY ROLLUP (pipeline)""")
def q_analysis_totals(t):
    s = scored(eval_results(t)).filter(c("hardness") == "easy")
    g = s.rollup("pipeline").agg(F.count(F.when(c("correct"), 1)).alias("matches"),
                                 F.round(F.sum("execution_time"), 6).alias("total_time"),
                                 F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("pipeline", F.lit("TOTAL")).alias("pipeline"), "matches", "total_time", "n")


@R.query("success_match_avg", ER + """
SELECT pipeline, count(*) FILTER (WHERE valid) AS success, count(*) FILTER (WHERE correct) AS exact_match,
  round(sum(execution_time) / count(*), 6) AS avg_time FROM sc GROUP BY pipeline""")
def q_success_match_avg(t):
    s = scored(eval_results(t))
    return s.groupBy("pipeline").agg(F.count(F.when(c("valid"), 1)).alias("success"),
                                     F.count(F.when(c("correct"), 1)).alias("exact_match"),
                                     F.round(F.sum("execution_time") / F.count(F.lit(1)), 6).alias("avg_time"))


# ------------------------------------------------------------------ registry (query_log)
QLH = f"WITH query_log AS ({QUERY_LOG_SQL}),\nqh AS (SELECT qid, db_id, {D.hardness('gold_sql')} AS hardness FROM query_log)\n"


@R.query("hardness_distribution", QLH + """
SELECT db_id, count(*) FILTER (WHERE hardness = 'easy') AS easy, count(*) FILTER (WHERE hardness = 'medium') AS medium,
  count(*) FILTER (WHERE hardness = 'hard') AS hard, count(*) AS total
FROM qh GROUP BY db_id ORDER BY easy + medium DESC, db_id LIMIT 15""")
def q_hardness_distribution(t):
    q = query_log(t).select("db_id", hardness_of("gold_sql").alias("h"))
    g = q.groupBy("db_id").agg(*[F.count(F.when(c("h") == h, 1)).alias(h) for h in ("easy", "medium", "hard")],
                               F.count(F.lit(1)).alias("total"))
    return g.orderBy((c("easy") + c("medium")).desc(), "db_id").limit(15)


@R.query("load_questions", QLH + """
SELECT row_number() OVER (ORDER BY qid) AS id, qid, hardness FROM qh WHERE db_id = '1-URGENT' AND hardness <> 'hard'""")
def q_load_questions(t):
    return load_questions(query_log(t), "1-URGENT")


def load_questions(log: DataFrame, db_id: str, limit: int | None = None) -> DataFrame:
    """numbered questions of one database, the first ``limit`` if given."""
    # 1-based position in file order without a single-partition window
    q = (log.filter(c("db_id") == db_id)
         .select("qid", "db_id", hardness_of("gold_sql").alias("hardness"))
         .filter(c("hardness") != "hard"))
    out = with_ordinal(q, "db_id", ["qid"], out="id").select("id", "qid", "hardness")
    return out if limit is None else out.filter(c("id") <= limit)


@R.query("stratified_sample", QLH + """
SELECT hardness, qid FROM (
  SELECT *, row_number() OVER (PARTITION BY hardness ORDER BY md5(CAST(qid AS VARCHAR) || '42'), qid) AS rn FROM qh) z
WHERE rn <= CASE hardness WHEN 'easy' THEN 10 WHEN 'medium' THEN 10 WHEN 'hard' THEN 10 WHEN 'extra' THEN 5 ELSE 0 END""")
def q_stratified_sample(t):
    return stratified_sample(query_log(t).select("qid", hardness_of("gold_sql").alias("hardness")), STRATA)


def stratified_sample(q: DataFrame, strata, seed: str = SAMPLE_SEED) -> DataFrame:
    """up to n questions (qid, hardness) of each listed class, in hash order; others give nothing."""
    w = Window.partitionBy("hardness").orderBy(F.md5(F.concat(c("qid").cast("string"), F.lit(seed))), "qid")
    cap = F.lit(0)
    for h, n in reversed(strata):
        cap = F.when(c("hardness") == h, F.lit(n)).otherwise(cap)
    # A literal bound (the largest cap) lets Spark insert a partial
    # WindowGroupLimit before the shuffle: each task forwards at most that
    # many rows per class, so a class holding most rows is never one sort.
    top = max(n for _, n in strata)
    return (q.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= top).filter(c("rn") <= cap)
            .select("hardness", "qid"))


def evaluation_dataset(q: DataFrame, size: int = 100) -> DataFrame:
    """a sample of ``size`` questions, a quarter from each class."""
    return stratified_sample(q, [(h, size // 4) for h, _ in STRATA])


@R.query("evaluation_dataset", QLH + """
SELECT hardness, qid FROM (
  SELECT *, row_number() OVER (PARTITION BY hardness ORDER BY md5(CAST(qid AS VARCHAR) || '42'), qid) AS rn FROM qh) z
WHERE rn <= 25 AND hardness IN ('easy', 'medium', 'hard', 'extra')""")
def q_evaluation_dataset(t):
    return evaluation_dataset(query_log(t).select("qid", hardness_of("gold_sql").alias("hardness")))


# ------------------------------------------------------------------ registry (events)
@R.query("first_success_attempt", f"""
WITH a AS (SELECT user_id, event_type = 'purchase' AS success, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
c AS (SELECT * FROM a WHERE attempt <= {RETRY_CAP}),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY success DESC,
        CASE WHEN success THEN attempt END ASC NULLS LAST, attempt DESC) AS rn FROM c)
SELECT user_id, CAST(attempt AS BIGINT) AS attempt, success, CAST(attempt - 1 AS BIGINT) AS retry_count,
       round(value, 6) AS value FROM p WHERE rn = 1""")
def q_first_success_attempt(t):
    ev = t.events.select("user_id", "event_id", "ts", (c("event_type") == "purchase").alias("success"), "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    capped = ev.withColumn("attempt", F.row_number().over(w)).filter(c("attempt") <= RETRY_CAP)
    pick = Window.partitionBy("user_id").orderBy(
        c("success").desc(), F.when(c("success"), c("attempt")).asc_nulls_last(), c("attempt").desc())
    return (capped.withColumn("rn", F.row_number().over(pick)).filter(c("rn") == 1)
            .select("user_id", c("attempt").cast("long").alias("attempt"), "success",
                    (c("attempt") - 1).cast("long").alias("retry_count"), F.round("value", 6).alias("value")))


@R.query("stage_timings", """
WITH o AS (SELECT user_id, event_type, epoch_us(ts) AS us,
                  lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_type AS stage, count(*) AS n, round(sum((us - prev) / 1e6), 6) AS total_s, round(avg((us - prev) / 1e6), 6) AS avg_s
FROM o WHERE prev IS NOT NULL GROUP BY event_type""")
def q_stage_timings(t):
    # lag() over a user would sort a whole user in one task; instead number
    # the events (distributed ordinal) and join each event to its predecessor.
    # microseconds since the epoch of the zone-free timestamp: independent of
    # the session time zone (a cast to TIMESTAMP would shift across DST changes)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ev = t.events.select("user_id", "event_id", "ts", "event_type",
                         F.timestamp_diff("MICROSECOND", epoch, c("ts")).alias("us"))
    o = with_ordinal(ev, "user_id", ["ts", "event_id"])
    prev = o.select("user_id", (c("ord") + 1).alias("ord"), c("us").alias("prev"))
    j = o.join(prev, ["user_id", "ord"])
    d = (c("us") - c("prev")) / 1e6
    return j.groupBy(c("event_type").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(d), 6).alias("total_s"), F.round(F.avg(d), 6).alias("avg_s"))


QUERIES = R.queries
ORACLES = R.oracles
