"""Row position inside a group without sending a group to one task.

``row_number() over (partition by g order by k)`` sorts each whole group in
one task; a group holding a third of the data would then be one task.  Here
the rows are range-partitioned on ``(g, k...)`` (a hot group is split over
many partitions), each partition numbers its rows locally via
``monotonically_increasing_id`` (contiguous inside a partition), and a tiny
table of per-(group, partition) counts gives every partition its offset.

The order key must be unique inside a group.  Range bounds are sampled with
a seed taken from the RDD id, so two plan branches that each re-run the
range shuffle may cut the data differently; the numbered rows are therefore
written once as Parquet in the cluster's checkpoint folder, and every later
branch reads the columns it needs from that one copy, which also survives
the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def with_ordinal(df: DataFrame, group, order: list[str], out: str = "ord",
                 partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group (one or several columns), by ``order``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = [group] if isinstance(group, str) else list(group)
    keys = groups + list(order)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    path = scratch_path(spark, "ordinal")
    s.write.parquet(path)
    s = spark.read.schema(s.schema).parquet(path)
    counts = s.groupBy(*groups, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # offs has (#groups x #partitions) rows at most and each of its window
    # groups at most #partitions rows.  Its size is not known up front, so
    # the join is left to AQE, which broadcasts it from the real shuffle size.
    return (s.join(offs, groups + ["_pid"])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
            .drop("_pid", "_mid", "_n", "_m0", "_off"))
