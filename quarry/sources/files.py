"""File sources, sinks and the vector store, as DataFrame I/O.

Readers always pass an explicit schema (no inference pass over the data);
JSON is written as JSON lines (splittable) and read back with either layout.
Nested report shapes are built with ``map_from_entries`` / ``struct`` from
already-aggregated rows, so nothing is assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import py_format
from ..operators.dense import l2_normalize
from ..operators.ordinal import with_ordinal

EXAMPLE_SCHEMA = "db_id string, question string, query string, hardness string"
SCHEMA_JSON_SCHEMA = "db_id string, table_names_original array<string>"
TEST_CASE_SCHEMA = ("question string, db_path string, gold_sql string, db_id string, hardness string, "
                    "relevant_tables array<string>, query_type string")


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


# Place of an entry: its file, the part of the file a task reads, and its turn in that task.
_PLACE = ("_file", "_part", "_turn")


def read_first(spark: SparkSession, path: str, schema: str, limit: int | None = None,
               multi_line: bool = False) -> DataFrame:
    """Entries of JSON files, all or the first ``limit`` in file order, files by path.

    A file holds JSON lines or, with ``multi_line``, one array.  A task gives
    the entries of a part of a file as they stand in it, so only order within a
    part is taken from the running number; each task keeps its first ``limit``.
    """
    entries = read_json(spark, path, schema, multi_line)
    if limit is None:
        return entries
    placed = entries.select("*", F.col("_metadata.file_path").alias("_file"),
                            F.col("_metadata.file_block_start").alias("_part"),
                            F.monotonically_increasing_id().alias("_turn"))
    return placed.orderBy(*_PLACE).limit(limit).drop(*_PLACE)


def load_split(spark: SparkSession, path: str, known_dbs: DataFrame, limit: int | None = None,
               multi_line: bool = False) -> DataFrame:
    """Questions of a split; the optional limit takes the first of the files, before unknown databases go.

    As with the original, a limit of 0 is none.
    """
    ex = read_first(spark, path, EXAMPLE_SCHEMA, limit or None, multi_line)
    ex = ex.withColumn("hardness", F.coalesce("hardness", F.lit("unknown")))
    return ex.join(known_dbs.select("db_id").distinct(), "db_id", "left_semi")


def load_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """A10: schema entries keyed by db_id; the last of several entries in the file wins.

    The file is one JSON array, so an entry's place is its position in it.
    """
    f = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"array<struct<{SCHEMA_JSON_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").alias("e"))
    s = f.select(F.posexplode("e").alias("pos", "x"))
    return s.groupBy(F.col("x.db_id").alias("db_id")).agg(
        F.max_by("x.table_names_original", "pos").alias("table_names_original"))


def write_json_array(df: DataFrame, order: str, path: str) -> str:
    """One JSON array file of a small metadata table, in the given order."""
    cols = [c for c in df.columns if c != order]
    df.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*cols).alias("x")))),
                                 lambda e: e["x"])).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def load_test_cases(spark: SparkSession, path: str, limit: int | None = None, multi_line: bool = False) -> DataFrame:
    """Test cases, all or the first of the files; a missing query_type reads as 'unknown'."""
    t = read_first(spark, path, TEST_CASE_SCHEMA, limit or None, multi_line)
    return t.withColumn("query_type", F.coalesce("query_type", F.lit("unknown")))


def to_test_cases(examples: DataFrame, table_names, include_relevant_tables: bool = True) -> DataFrame:
    """Examples projected to test cases, with relevant tables (C11) of the gold SQL."""
    from ..functions.sqltext import relevant_tables
    out = examples.select("question", F.concat(F.lit("db/"), "db_id").alias("db_path"),
                          F.col("query").alias("gold_sql"), "db_id", "hardness")
    if include_relevant_tables:
        out = out.withColumn("relevant_tables", relevant_tables("gold_sql", table_names))
    return out


# ---------------------------------------------------------------- CSV / JSON report sinks

def detail_wide(scored: DataFrame, pipelines) -> DataFrame:
    """A14 data: one row per question, SQL / Yes-No / time per pipeline (pivot of tiny groups)."""
    p = (scored.groupBy("id", "question", "hardness", "gold_sql").pivot("pipeline", list(pipelines))
         .agg(F.first("generated_sql").alias("SQL"),
              F.first(F.when(F.col("correct"), "Yes").otherwise("No")).alias("Correct"),
              F.first("execution_time").alias("Time")))
    # a pipeline without an outcome reads as an empty, wrong answer that took no time
    return p.fillna({f"{n}_SQL": "" for n in pipelines} | {f"{n}_Correct": "No" for n in pipelines}
                    | {f"{n}_Time": 0.0 for n in pipelines})


def write_detail_csv(wide: DataFrame, pipelines, path: str) -> str:
    """CSV with quoted multi-line SQL and one-decimal times."""
    cols = [F.col("id").alias("ID"), F.col("question").alias("Question"), F.col("hardness").alias("Hardness"),
            F.col("gold_sql").alias("Gold SQL")]
    for p in pipelines:
        cols += [F.col(f"{p}_SQL").alias(f"{p}_SQL"), F.col(f"{p}_Correct").alias(f"{p}_Correct"),
                 py_format(F.col(f"{p}_Time"), ".1f").alias(f"{p}_Time")]
    wide.select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True) \
        .option("escape", '"').csv(path)
    return path


def read_detail_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def summary_text(summary: DataFrame) -> DataFrame:
    """The 12-column summary with percentages as text."""
    def pct(c):
        return py_format(c, ".1%")
    return summary.select(
        F.replace("pipeline", F.lit("_"), F.lit(" ")).alias("Pipeline"), F.col("total_questions").alias("Total Questions"),
        pct("execution_accuracy").alias("Execution Accuracy"), pct("exact_set_match_rate").alias("Exact Set Match"),
        pct("avg_component_score").alias("Component Score"),
        pct("select_match_rate").alias("SELECT Match"), pct("from_match_rate").alias("FROM Match"),
        pct("where_match_rate").alias("WHERE Match"), pct("groupby_match_rate").alias("GROUP BY Match"),
        pct("orderby_match_rate").alias("ORDER BY Match"),
        py_format("avg_time_per_question", ".1f").alias("Avg Time (s)"),
        py_format("total_time", ".1f").alias("Total Time (s)"))


def combined_text(totals: DataFrame) -> DataFrame:
    """Per-DB rows, an empty row, a title row and the ALL DATABASES totals, in file order."""
    last = F.col("database") == "ALL DATABASES"
    rows = totals.select(
        F.when(last, 3).otherwise(0).alias("part"), F.col("database").alias("Database"),
        F.replace("pipeline", F.lit("_"), F.lit(" ")).alias("Pipeline"),
        F.col("total").cast("string").alias("Total Questions"), F.col("correct").cast("string").alias("Correct"),
        py_format("accuracy", ".1%").alias("Accuracy"), py_format("avg_time", ".1f").alias("Avg Time (s)"))
    between = totals.sparkSession.createDataFrame(
        [(1, None), (2, "COMBINED TOTALS")], "part int, Database string")
    # a report of databases x pipelines rows: one sorted file
    return rows.unionByName(between, allowMissingColumns=True).orderBy("part", "Database", "Pipeline").drop("part")


def write_csv(df: DataFrame, path: str) -> str:
    """Header CSV."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


DETAIL_FIELDS = ["generated_sql", "execution_time", "valid", "correct", "exact_set_match", "component_score",
                 "select_match", "from_match", "where_match", "groupby_match", "orderby_match", "error"]


def detail_json(scored: DataFrame) -> DataFrame:
    """A17 shape: one record per question, ``pipelines`` = map(pipeline -> outcome struct)."""
    inner = F.struct(*[F.col(c) for c in DETAIL_FIELDS])
    return scored.groupBy("db_id", "id", "question", "gold_sql", "hardness").agg(
        F.map_from_entries(F.collect_list(F.struct("pipeline", inner))).alias("pipelines"))


def combined_json(summary: DataFrame) -> DataFrame:
    """A18 shape: totals per pipeline plus nested per-database summaries."""
    per_db = summary.groupBy("pipeline").agg(
        F.sum("total_questions").alias("total_questions"),
        F.sum(F.col("execution_accuracy") * F.col("total_questions")).alias("correct_answers"),
        F.sum("total_time").alias("total_time_seconds"),
        F.map_from_entries(F.collect_list(F.struct(
            "db_id", F.struct("total_questions", "execution_accuracy", "avg_time_per_question")))).alias("per_database"))
    return per_db.select("pipeline", "total_questions", F.round("correct_answers").cast("long").alias("correct_answers"),
                         (F.col("correct_answers") / F.col("total_questions")).alias("execution_accuracy"),
                         "total_time_seconds",
                         (F.col("total_time_seconds") / F.col("total_questions")).alias("avg_time_per_question"),
                         "per_database")


# ---------------------------------------------------------------- vector store

STORE_SCHEMA = "id string, seq long, content string, db_name string, vector array<double>"


def store_add(store: DataFrame | None, batch: DataFrame, id_col: str | None, content: str, db_name: str,
              vec: str, order: str, base: int = 0) -> DataFrame:
    """Append a batch with unit vectors; a missing id becomes ``doc_<position>``.

    ``order`` is the batch's own row order (position = ordinal by it, computed
    without a single-partition window); positions start behind the store's, or
    at ``base``.
    """
    last = None if store is None else store.agg(F.max("seq")).first()[0]
    base = base if last is None else last + 1
    # as many vectors as documents: a document without one is an error, not a gap
    vec = F.when(F.col(vec).isNull(), F.raise_error(F.lit("a document has no vector"))).otherwise(F.col(vec))
    b = batch.select((F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")).alias("id"),
                     F.col(content).alias("content"), F.col(db_name).alias("db_name"),
                     l2_normalize(vec).alias("vector"), F.lit(1).alias("_g"), F.col(order).alias("_o"))
    b = with_ordinal(b, "_g", ["_o"], out="_pos")
    b = b.select(F.coalesce("id", F.concat(F.lit("doc_"), (F.col("_pos") - 1 + base).cast("string"))).alias("id"),
                 (F.col("_pos") - 1 + base).alias("seq"), "content", "db_name", "vector")
    return b if store is None else store.unionByName(b)


def store_get(store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One document per id, the last added (highest seq) wins."""
    latest = store.groupBy("id").agg(F.max_by(F.struct("seq", "content", "db_name", "vector"), "seq").alias("d"))
    out = latest.select("id", "d.*")
    return out if ids is None else out.join(ids, "id", "left_semi")


def store_save(store: DataFrame, path: str) -> str:
    """Parquet, partitioned by database (partition pruning on load by db_name)."""
    # no database in one task, and no more files of one than there are tasks
    tasks = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.repartition("db_name", F.pmod(F.xxhash64("id"), F.lit(tasks)))
    dealt.write.mode("overwrite").partitionBy("db_name").parquet(path)
    return path


def store_load(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved store, or None when nothing was saved there."""
    from ..session import path_exists
    if not path_exists(spark, path):
        return None
    return spark.read.schema(STORE_SCHEMA).parquet(path)
