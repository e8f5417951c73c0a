"""Bounded samples of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, materialize

# Labelled rows a classifier is fitted on, at most (about): a hash of the id
# decides, so the sample is the same in every run.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold_mod: int, held: int,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y, part) of training rows: ``part`` 0 fits, 1 calibrates.

    Rows whose crc32 fold equals ``held`` are left out.  Exact copies count
    once.  A document with several label rows has the largest; null labels
    and null ids are no labels.
    """
    lab = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
           .where(crc_mod("doc_id", fold_mod) != held)
           .groupBy("doc_id").agg(F.max(label).cast("double").alias("y")))
    n = lab.count()
    if n > rows:
        # the share of all 64-bit hashes, whatever the number of labels
        lab = lab.where(F.xxhash64("doc_id") < F.lit((1 << 64) * rows // n - (1 << 63)))
    lab = lab.select(F.col("doc_id").alias("l_id"), "y")
    if n <= 4 * rows:  # its size is known, so it may be shared with every task
        lab = F.broadcast(lab)
    d = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
         .join(lab, F.col("doc_id") == F.col("l_id")).drop("l_id"))
    d = materialize(d.withColumn("copy", F.xxhash64("text")), "labelled")
    first = (d.groupBy("copy").agg(F.min(F.struct("doc_id", "y")).alias("f"))
             .select(F.col("copy").alias("c"), "f.doc_id", "f.y"))
    one = d.dropDuplicates(["doc_id", "copy"]).drop("y").join(
        first.withColumnRenamed("doc_id", "f_id"), (F.col("copy") == F.col("c")) & (F.col("doc_id") == F.col("f_id")))
    return one.select("doc_id", "text", "y",
                      F.when(F.pmod(F.xxhash64("copy", F.lit(7)), F.lit(10)) < 7, 0).otherwise(1).alias("part"))


def in_both_parts(sample: DataFrame) -> DataFrame | None:
    """``sample`` with rows of both labels in both parts; None without rows of both labels.

    Where all rows of a label fell in one part, the one with the smallest text
    hash changes to the other; the only row of a label is in both parts.
    """
    text = F.xxhash64("text")
    have = {(r["y"], r["part"]): r for r in sample.groupBy("y", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min(text).alias("first")).collect()}
    if {y for y, _ in have} != {0.0, 1.0}:
        return None
    for y, part in list(have):
        if (y, 1 - part) in have:
            continue
        row = (F.col("y") == y) & (text == have[y, part]["first"])
        if have[y, part]["n"] > 1:
            sample = sample.withColumn("part", F.when(row, F.lit(1 - part)).otherwise(F.col("part")))
        else:
            sample = sample.unionByName(sample.where(row).withColumn("part", F.lit(1 - part)))
    return sample


def base_rate(sample: DataFrame) -> float:
    return float(sample.agg(F.avg("y")).head()[0] or 0.0)
