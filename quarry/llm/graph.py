"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint): the smallest node it reaches.

    Alternates the two star operations on links directed from larger to
    smaller nodes until nothing changes; the number of rounds grows with the
    logarithm of the longest path.  Every round is written to the shared
    checkpoint folder, nothing is collected but a count and a checksum.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        F.col("u") != F.col("v")).distinct()
    e = materialize(e, "links")
    state = _state(e)
    while state[0]:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        big = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = big.join(low, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(),
                        "links")
        now = _state(e)
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(
        F.min("root").alias("root"))
