"""Operator 9: mix sources to target weights.

Efraimidis-Spirakis sampling without replacement: every document gets the key
``-ln(u) / quality weight`` with ``u`` a hash of its id; within a source the
smallest keys are taken first until the source's token budget is used.  A
budget above the source's size is served by complete epochs first; only the
fraction that remains is sampled.

All DataFrame operations.  The prefix sum inside a source never gathers the
source in one task: keys are cut into buckets of about ``BUCKET_ROWS``
documents, the running sum inside a bucket is a window over that bucket, and
the bucket's offset comes from a small table with one row per bucket.

Defined results: null or empty text has size 0 and takes 0 words; a null
source is a source of its own, ranked last; a null document id hashes as the
empty text; a null, missing or non-positive quality weight counts as 1;
repeated rows are documents of their own (equal keys are taken in id and size
order); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

WORD_GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
# Documents in one prefix-sum bucket.
BUCKET_ROWS = 4096
# Sampling weight of a document by its quality label.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets per source by water filling: (source, source_size, ...) -> + target double.

    ``sizes`` has one row per source.  Sources sorted by the level at which
    they reach their cap fill first; the first source whose cap lies above
    the common level fixes the level of itself and all later ones.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    d = (sizes.withColumn("weight", pick.cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(),
                      F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    d = (d.withColumn("rest", F.sum("source_size").over(W.partitionBy())
                      - F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long")))
         .withColumn("wrest", F.sum("weight").over(W.partitionBy())
                     - F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long")))
         .withColumn("open", F.col("cap") * F.col("wrest") > F.col("rest") * F.col("weight")))
    first = W.partitionBy()
    d = (d.withColumn("level_rest", F.min(F.when(F.col("open"), F.struct(
            (F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"),
            F.col("source").alias("s"), F.col("rest"), F.col("wrest")))).over(first))
         .withColumn("target", F.when(
             F.col("open"),
             (F.col("level_rest.rest") * F.col("weight")).cast("double") / F.col("level_rest.wrest"))
             .otherwise(F.col("cap").cast("double"))))
    return d.drop("cap", "rest", "wrest", "open", "level_rest")


def mix(docs: DataFrame, quality: Column | None = None, seed: str = SEED, weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds source_size, target, taken and key to (doc_id, source, size and ``keep``).

    ``size`` is the document's word count, ``quality`` its sampling weight.
    The document at the edge of a budget is taken in part, so a source takes
    ``floor(target)`` words.

    The columns of ``keep`` may be texts: they are written once and never
    shuffled here.  The rows without them give each source's edge, the last
    row that its budget reaches; a second read compares every row with the
    edge of its source.  Rows equal in key, id and size are told apart by
    their place in the written table.
    """
    w = F.lit(1.0) if quality is None else F.when(quality > 0, quality).otherwise(F.lit(1.0))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.lit(":" + seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    d = materialize(docs.select("doc_id", "source", "size", (-F.log(u) / w).alias("key"), *kept),
                    "mix-docs")
    place = ("file", "row") if keep else ()
    if keep:
        full = d.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        d = full.select("doc_id", "source", "size", "key", *place)
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"),
                                    F.count(F.lit(1)).alias("n_docs"))
    targets = (source_targets(sizes, weights, max_epochs)
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.least(
                   F.lit(max_epochs).cast("long"),
                   F.floor(F.col("target") / F.col("source_size"))))
                   .otherwise(F.lit(0)).cast("long"))
               .withColumn("budget", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
               .withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows))
               .withColumnRenamed("source", "t_source"))
    # key order inside a source follows the bucket number: 1 - exp(-key) is
    # increasing in the key and spreads keys over (0, 1)
    d = (d.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
         .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets"))))
    per = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = per.select(
        F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"),
        F.coalesce(F.sum("bucket_size").over(
            W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0).cast("long")).alias("offset"))
    inside = (W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *place)
              .rowsBetween(W.unboundedPreceding, -1))
    d = (d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
         .join(offsets, F.col("source").eqNullSafe(F.col("o_source"))
               & (F.col("bucket") == F.col("o_bucket"))).drop("o_source", "o_bucket"))
    part = F.greatest(F.lit(0).cast("long"),
                      F.least(F.col("size"), F.col("budget") - F.col("before") - F.col("offset")))
    if not keep:
        return d.select("doc_id", "size", "source", "source_size", "target", "key",
                        (F.col("epochs") * F.col("size") + part).alias("taken"))
    at = F.struct("key", "doc_id", "size", *place)
    reached = F.when(F.col("part") > 0, at)
    # written, so that its size is known and the rows with texts need not move to meet it
    edges = materialize(
        d.withColumn("part", part).groupBy(F.col("source").alias("e_source"), "source_size", "target", "epochs")
        .agg(F.max(reached).alias("edge"), F.max_by("part", reached).alias("edge_part")), "mix-edges")
    part = (F.when(at < F.col("edge"), F.col("size")).when(at > F.col("edge"), F.lit(0).cast("long"))
            .otherwise(F.coalesce("edge_part", F.lit(0).cast("long"))))
    return full.join(edges, F.col("source").eqNullSafe(F.col("e_source"))).select(
        "doc_id", "size", "source", "source_size", "target", "key",
        (F.col("epochs") * F.col("size") + part).alias("taken"),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def label_weights(labels: DataFrame) -> DataFrame:
    """One row per labelled document: q_id, quality (the largest label)."""
    return (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("q_id"))
            .agg(F.max("quality").alias("q_quality")))


def mix_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mix (doc_id, text, source): sizes from whole texts, weights from quality labels."""
    sized = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"))
    q = label_weights(labels)
    d = sized.join(q, F.col("doc_id") == F.col("q_id"), "left")
    weight = (F.when(F.col("q_quality") == 1, F.lit(QUALITY_WEIGHT[1]))
              .when(F.col("q_quality") == 0, F.lit(QUALITY_WEIGHT[0])).otherwise(F.lit(1.0)))
    return mix(d, weight, keep=keep)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}

ORACLES = {"op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
q AS (SELECT doc_id AS q_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT d.*, -ln(u) / (CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
      FROM d LEFT JOIN q ON doc_id = q_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
             [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight
      FROM k GROUP BY source),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS wrest
      FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * wrest > rest * weight AS open FROM f),
l AS (SELECT rest AS lrest, wrest AS lw FROM g WHERE open ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN open THEN CAST((SELECT lrest FROM l) * weight AS DOUBLE) / (SELECT lw FROM l)
                  ELSE CAST(cap AS DOUBLE) END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
             CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM p
"""}
