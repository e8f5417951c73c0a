import collections

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from tests.llm.helpers import LABEL, doc_rows, docs, empty_docs, words


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        t = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: float(cap * sizes[s]) for s in over}


def check(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in g) for s, g in by.items()}
    target = fill(sizes)
    for s, g in by.items():
        assert all(r["source_size"] == sizes[s] for r in g)
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in g)
        assert abs(sum(r["taken"] for r in g) - target[s]) < 1 + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in g)
        full = int(target[s] // sizes[s]) if sizes[s] else 0
        assert all(r["taken"] >= min(full, 3) * r["size"] for r in g)


def test_targets_and_budgets(spark):
    d = spark.createDataFrame([(i, f"{'w ' * (i % 17 + 1)}", ["a", "b", "c", "d", None][i * i % 5]) for i in range(400)]
                              + [(1000 + i, "x y z " * 50, "hot") for i in range(300)],
                              "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(None, 1, 1), (5, None, None)], LABEL)
    a = mixing.mix_documents(d, lab).collect()
    check(a)
    b = mixing.mix_documents(d.repartition(7), lab).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_prefix_sum_does_not_depend_on_buckets(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                (F.col("id") % 13).alias("size")).union(
        spark.createDataFrame([(9000, "t", 4)], "doc_id long, source string, size long"))
    one = mixing.mix(d, bucket_rows=10_000).orderBy("doc_id").collect()
    many = mixing.mix(d, bucket_rows=16).orderBy("doc_id").collect()
    assert one == many


def test_better_documents_come_first(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b")
                                 .alias("source"), F.lit(10).cast("long").alias("size"))
    q = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    m = mixing.mix(d, q).where("source = 'b'")
    good = m.where("doc_id % 2 = 0").agg(F.sum("taken")).head()[0]
    rest = m.where("doc_id % 2 = 1").agg(F.sum("taken")).head()[0]
    assert good > 1.5 * rest


def test_edges(spark):
    lab = spark.createDataFrame([], LABEL)
    rows = mixing.mix_documents(docs(spark, extra=("size", "key", "q_id", "target")), lab).collect()
    assert len(rows) == len(doc_rows())
    check(rows)
    got = sorted(r["size"] for r in rows)
    assert got == sorted(len(words(r[1])) for r in doc_rows())
    assert mixing.mix_documents(empty_docs(spark), lab).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 0}, {"a": 10}, {"a": 1, "b": 1000, None: 5, "c": 2}])
def test_water_filling(spark, sizes):
    s = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(s).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
