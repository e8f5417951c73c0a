"""Operator 5: embedding near-duplicates by cross-polytope hashing.

Vectors of one label are hashed by fast Hadamard rotations (random signs and a
Walsh-Hadamard transform, three times) to the nearest signed axis; two such
hashes make a bucket key of a table.  Every vector is stored under its own key
in each table and also looks up the keys of its next-best axes (multiprobe).
Pairs that meet are verified by cosine in double precision.

Vectors that are equal after scaling to unit length, and have one label, are
one class from the start: a class is a row with its members counted, so a
vector on a third of all rows costs one row.  Buckets are met by a join that
Spark may split, no bucket is gathered in one task, and no bucket is capped.

Defined results: a null label, a null, empty or zero vector and one with null
or non-finite components link with nothing; vectors of different lengths never
link; repeated rows are copies that link with each other; a null id is kept as
its own component (null) and counts as a link; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table
from quarry.llm.graph import components

COSINE = 0.93
# Recall of pairs at the threshold itself, measured on 64 components: 0.999.
TABLES = 6
PROBES = 3
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, by halves."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size=x.shape[1]))
    return x


def axes(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` nearest signed axes of every row, nearest first, and how far each falls short."""
    a = np.abs(x)
    top = np.argsort(-a, axis=1, kind="stable")[:, :probes]
    size = np.take_along_axis(a, top, axis=1)
    sign = np.take_along_axis(x, top, axis=1) < 0
    return top * 2 + sign, size[:, :1] - size


def bucket_keys(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED):
    """(n, tables, 1 + probes) keys: a vector's own bucket first, then the next nearest ones."""
    n, d = x.shape
    width = 1 << max(1, int(d - 1).bit_length())
    pad = np.zeros((n, width))
    pad[:, :d] = x
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        (a, da), (b, db) = (axes(rotate(pad, seed + 7919 * (2 * t + j)), min(probes + 1, width)) for j in (0, 1))
        # all pairs of near axes, by the length lost to the own bucket
        cost = da[:, :, None] ** 2 + db[:, None, :] ** 2
        order = np.argsort(cost.reshape(n, -1), axis=1, kind="stable")[:, :1 + probes]
        i, j = order // b.shape[1], order % b.shape[1]
        key = (np.take_along_axis(a, i, 1) * (2 * width) + np.take_along_axis(b, j, 1)) * tables + t
        out[:, t, :key.shape[1]] = key
        out[:, t, key.shape[1]:] = key[:, :1]
    return out


def unit_of(v) -> np.ndarray | None:
    """The vector at unit length in double precision; None where it cannot link."""
    if not v:
        return None
    x = np.array(v, dtype=np.float64)  # a null component reads as NaN
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, u array<double>): unit vectors, null where a row cannot link."""

    def run(batches):
        for b in batches:
            u = [None if lab is None else unit_of(v) for v, lab in zip(
                b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array(u, pa.list_(pa.float64()))],
                names=["vec_id", "label", "u"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {kinds[0]}, label {kinds[1]}, u array<double>")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES,
                    probes: int = PROBES) -> DataFrame:
    """(vec_id, label, embedding) -> vec_id, n_links, component_id, kept, one row a vector."""
    spark = vectors.sparkSession
    u = materialize(unit_vectors(vectors).withColumn("h", F.xxhash64("label", "u")), "units")
    able = u.where(F.col("u").isNotNull())
    # numbered by a hash of label and vector; equal rows share it
    cls = materialize(able.groupBy("h").agg(
        F.first("label").alias("label"), F.first("u").alias("u"), F.count(F.lit(1)).alias("m"),
        F.min("vec_id").alias("low")), "classes")

    def hash_rows(batches):
        for b in batches:
            ids, us = b.column("h").to_pylist(), b.column("u").to_pylist()
            label = b.column("l").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(us):
                by_size.setdefault(len(x), []).append(i)
            for d, at in by_size.items():
                k = bucket_keys(np.array([us[i] for i in at], dtype=np.float64), tables, probes)
                n, width = len(at), k.shape[1] * k.shape[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([ids[i] for i in at], width), pa.int64()),
                     pa.array(np.repeat([label[i] for i in at], width), pa.int64()),
                     pa.array(np.full(n * width, d, np.int32)), pa.array(k.reshape(-1)),
                     pa.array(np.tile(np.arange(k.shape[2]) == 0, n * k.shape[1]))],
                    names=["h", "l", "d", "key", "own"])

    keyed = cls.select("h", F.xxhash64("label").alias("l"), "u").mapInArrow(
        hash_rows, "h long, l long, d int, key long, own boolean")
    keyed = materialize(keyed.dropDuplicates(["h", "key", "own"]), "buckets")
    stored = keyed.where("own").select("l", "d", "key", F.col("h").alias("b"))
    asks = keyed.select("l", "d", "key", F.col("h").alias("a"))
    met = asks.join(stored, ["l", "d", "key"]).where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    one, two = (cls.select(F.col("h").alias(c), F.col("label").alias(f"l{c}"), F.col("u").alias(f"u{c}"),
                           F.col("m").alias(f"m{c}")) for c in ("a", "b"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = met.join(one, "a").join(two, "b").where(F.col("la") == F.col("lb")).where(dot >= threshold).select(
        "a", "b", "ma", "mb")
    links = materialize(links, "vector-links")
    degree = (links.select(F.col("a").alias("x"), F.col("mb").alias("m"))
              .unionByName(links.select(F.col("b").alias("x"), F.col("ma").alias("m")))
              .groupBy("x").agg(F.sum("m").alias("others")))
    root = components(links.select("a", "b")).withColumnRenamed("node", "y")
    named = (cls.select("h", "m", "low").join(degree, F.col("h") == F.col("x"), "left")
             .join(root, F.col("h") == F.col("y"), "left")
             .select(F.col("h").alias("k"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                     "low", F.coalesce("root", "h").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(lowest, F.col("root") == F.col("r")).select("k", "n_links", "component_id")
    out = u.select("vec_id", F.when(F.col("u").isNotNull(), F.col("h")).alias("h")).join(
        named, F.col("h") == F.col("k"), "left")
    comp = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_vectors": op5_vectors}
