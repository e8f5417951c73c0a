"""Incremental evaluation rollup with Structured Streaming.

The evaluation loop accumulates per-(database, pipeline) counters as each
question finishes.  Here the per-question outcome rows arrive as files; a
streaming aggregation keeps the counters as state and emits the complete
table after every micro-batch: Parquet, in a folder named by the batch, so a
batch that is run again writes the same folder.  ``rollup_stream`` resumes from the checkpoint
folder it is given; the registered query uses a fresh one for each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME_SCHEMA = ("db_id string, id long, pipeline string, hardness string, valid boolean, correct boolean, "
                  "exact_set_match boolean, select_match boolean, from_match boolean, where_match boolean, "
                  "groupby_match boolean, orderby_match boolean, execution_time double, generated_sql string, "
                  "question string")


def rollup_stream(spark: SparkSession, source_dir: str, checkpoint: str, out_dir: str,
                  files_per_trigger: int = 1) -> DataFrame:
    """Run the rollup over every file present now (availableNow) and return the table of the last batch.

    With no new file since the last run the table of that run is returned;
    without any outcome it is empty.
    """
    from ..plans.reports import scored
    from ..session import path_exists
    src = (spark.readStream.schema(OUTCOME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .json(source_dir))
    s = scored(src)
    agg = s.groupBy("db_id", "pipeline").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("int")).cast("long").alias("correct"),
        F.sum(F.col("valid").cast("int")).cast("long").alias("valid"), F.sum("execution_time").alias("total_time"))

    def emit(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(emit)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out_dir):  # no outcome has ever arrived
        return spark.createDataFrame([], agg.schema)
    batches = spark.read.schema(agg.schema.add("batch", "long")).parquet(out_dir)
    last = batches.agg(F.max("batch")).first()[0]
    return batches.where(F.col("batch") == F.lit(last)).drop("batch")


def _q_rollup(spark, sf_dir):
    from ..plans.derived import eval_results
    from ..session import Tables, scratch_path
    t = Tables(spark, sf_dir)
    base = scratch_path(spark, "stream")
    # the outcome log arrives as the files its tasks write, and is read in batches of some of them
    eval_results(t).drop("gold_sql", "error").write.json(base + "/in")
    out = rollup_stream(spark, base + "/in", base + "/state", base + "/out", files_per_trigger=1000)
    return out.select("db_id", "pipeline", "total", "correct", "valid", F.round("total_time", 6).alias("total_time"))


def _oracle():
    from ..plans.derived import EVAL_RESULTS_SQL
    return f"WITH er AS ({EVAL_RESULTS_SQL})\n" + """
SELECT db_id, pipeline, count(*) AS total,
  CAST(sum(CASE WHEN generated_sql <> '' AND correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(sum(CASE WHEN generated_sql <> '' AND valid THEN 1 ELSE 0 END) AS BIGINT) AS valid,
  round(sum(execution_time), 6) AS total_time
FROM er GROUP BY db_id, pipeline"""


QUERIES = {"streaming_rollup": _q_rollup}
ORACLES = {"streaming_rollup": _oracle()}
