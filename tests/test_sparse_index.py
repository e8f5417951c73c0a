"""The kept BM25 index: exact results, few pairs, segments equal to one build."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25 as B
from quarry.operators import sparse_index as S


def _table(spark, seed=4, n=400):
    rnd = random.Random(seed)
    words = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(n)]
    docs += [(n, ""), (n + 1, None), (n + 2, docs[0][1]), (n + 3, "the " * 500)]
    qs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    qs += [(100, "the of and"), (101, "absent"), (102, ""), (103, None)]
    return spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(qs, "q long, t string")


def _hits(df):
    return sorted((r["qid"], r["rank"], r["doc"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_equal_to_scoring_all_pairs(spark, k, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    docs, qs = _table(spark)
    want = B.top_k(B.bm25_scores(B.tokens_of(docs, "id", "t"), qs, "q", "t"), k)
    got = S.SparseIndex(spark).add(docs, "id", "t").topk(qs, "q", "t", k)
    assert _hits(got) == _hits(want)


def test_batches_equal_one_build(spark):
    docs, qs = _table(spark)
    one = S.SparseIndex(spark).add(docs, "id", "t")
    two = S.SparseIndex(spark)
    for i in range(3):
        two = S.SparseIndex(spark, two.path).add(docs.where(F.col("id") % 3 == i), "id", "t")
    assert two.segments() == [0, 1, 2] and two.stats() == one.stats()
    assert sorted(map(tuple, two.terms().collect())) == sorted(map(tuple, one.terms().collect()))
    assert _hits(two.topk(qs, "q", "t", 5)) == _hits(one.topk(qs, "q", "t", 5))


def test_opened_without_the_documents(spark, tmp_path):
    docs, qs = _table(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    source = spark.read.parquet(str(tmp_path / "docs"))
    path = S.SparseIndex(spark).add(source, "id", "t").path
    again = S.SparseIndex(spark, path).topk(qs, "q", "t", 3)
    assert str(tmp_path) not in again._jdf.queryExecution().toString()
    assert again.count() > 0


def test_a_failed_batch_is_not_seen(spark):
    docs, qs = _table(spark)
    index = S.SparseIndex(spark).add(docs, "id", "t")
    before = _hits(index.topk(qs, "q", "t", 5))
    # tokens of a batch whose statistics were never written
    spark.createDataFrame([(9999, ["w1"])], "doc long, toks array<string>").write.parquet(f"{index.path}/tokens/segment=1")
    assert index.segments() == [0] and _hits(index.topk(qs, "q", "t", 5)) == before


def test_frequent_terms_are_not_read(spark, monkeypatch):
    """Documents read for a query grow with its rare terms, not with the corpus."""
    docs = spark.range(6000).select(F.col("id"), F.concat(
        F.lit("the of "), F.concat(F.lit("w"), (F.col("id") % 600).cast("string"))).alias("t"))
    qs = spark.range(50).select(F.col("id").alias("q"), F.concat(F.lit("the of w"), F.col("id").cast("string")).alias("t"))
    index = S.SparseIndex(spark).add(docs, "id", "t")
    seen, partial = [], S.SparseIndex._partial

    def counted(self, *a):
        out = partial(self, *a)
        seen.append(out.count())
        return out
    monkeypatch.setattr(S.SparseIndex, "_partial", counted)
    assert index.topk(qs, "q", "t", 5, seeds=1).count() == 250
    assert max(seen) <= 50 * 10  # a query's rare term, of 50 x 6000 pairs


def test_empty_index(spark):
    _, qs = _table(spark)
    assert S.SparseIndex(spark).topk(qs, "q", "t", 5).collect() == []
    empty = spark.createDataFrame([], "id long, t string")
    assert S.SparseIndex(spark).add(empty, "id", "t").topk(qs, "q", "t", 5).collect() == []
