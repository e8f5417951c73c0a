"""Many queries over few documents: dealt by query once, blocks in bounded numbers."""

from pyspark.sql import functions as F

from quarry.operators import bm25 as B
from quarry.operators import dense as D
from quarry.operators import hybrid as H
from quarry.operators import sizing as Z
from quarry.operators import sparse_index as S
from quarry.operators.retrieval_eval import METHODS, schema_retrieval_prf


def _plans(df):
    q = df._jdf.queryExecution()
    return q.optimizedPlan().toString(), q.executedPlan().toString()


def _few(spark):
    docs = [(i, f"orders of customer w{i % 7} " * (i % 4 + 1)) for i in range(30)] + [(30, ""), (31, None), (None, "orders")]
    qs = [(i, f"w{i % 9} orders of customer {i}") for i in range(300)] + [(5, "w3 w3"), (None, "orders"), (400, None), (401, "absent")]
    return spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(qs, "q long, t string")


def _hits(df):
    return sorted((r["qid"], r["rank"], str(r["doc"]), round(r["score"], 8)) for r in df.collect())


def test_queries_over_few_documents_are_dealt_once(spark):
    docs, qs = _few(spark)
    tokens = B.tokens_of(docs, "id", "t")
    want = _hits(B.top_k(B.bm25_scores(tokens, qs, "q", "t"), 5).where("qid IS NOT NULL"))
    for got in (B.bm25_topk(tokens, qs, "q", "t", 5), S.SparseIndex(spark).add(docs, "id", "t").topk(qs, "q", "t", 5)):
        assert _plans(got)[1].count("Exchange hashpartitioning") == 1
        assert [h for h in _hits(got) if h[2] != "None"] == [h for h in want if h[2] != "None"]


def test_tasks_follow_the_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(Z, "PER_TASK", 10)
    docs, qs = _few(spark)
    got = S.SparseIndex(spark).add(docs, "id", "t").topk(qs, "q", "t", 5)
    assert "RepartitionByExpression [qid" in _plans(got)[0] and "], 31" in _plans(got)[0]


def test_a_task_meets_a_bounded_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 10)
    monkeypatch.setattr(D, "PAIRS", 4)
    vectors = spark.range(40).repartition(8).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v"))
    qs = spark.range(0, 300, 1, 4).select(F.col("id").alias("q"), F.array(F.lit(1.0), F.col("id") + 1.0).alias("qv"))
    got = D.dense_topk(vectors, "id", "v", qs, "q", "qv", 3)
    # 300 queries make 32 blocks; the 40 documents are one block
    assert "Repartition 8, true" in _plans(got)[0]
    assert got.count() == 900


def test_fusion_equals_an_outer_join(spark):
    dense = [(1, 10, 0.9), (1, 11, 0.5), (1, 12, 0.1), (2, 10, 0.3), (3, 10, 0.7), (3, 10, 0.7), (3, 11, 0.2),
             (None, 10, 0.4), (4, None, 0.6), (4, 11, 0.1)]
    sparse = [(1, 11, 7.0), (1, 13, 2.0), (3, 10, 4.0), (3, 12, 1.0), (4, None, 2.0), (4, 11, 1.0), (5, 10, 3.0)]
    d, s = (spark.createDataFrame(x, "qid long, doc long, score double") for x in (dense, sparse))
    j = (H.minmax_normalize(d).select("qid", "doc", F.col("norm").alias("a"))
         .join(H.minmax_normalize(s).select("qid", "doc", F.col("norm").alias("b")), ["qid", "doc"], "full_outer").fillna(0.0, ["a", "b"]))
    want = sorted((str(r["qid"]), str(r["doc"]), round(r["a"] * 0.6 + r["b"] * 0.4, 9)) for r in j.collect())
    got = H.fuse(s, d, 100, 5)
    assert _plans(got)[1].count("Exchange") == 1
    assert sorted((str(r["qid"]), str(r["doc"]), round(r["score"], 9)) for r in got.collect()) == want


def test_precision_of_repeated_questions_and_documents(spark):
    run = spark.createDataFrame([("sparse", 1, 7), ("sparse", 1, 8), ("sparse", 1, 9), ("hybrid", 1, 9), ("dense", 2, 7)],
                                "method string, qid long, doc long")
    tables = spark.createDataFrame([(7, "Orders"), (8, "orders"), (8, "part"), (9, "")], "doc long, table string")
    truth = spark.createDataFrame([(1, "orders"), (1, "orders"), (1, "nation"), (2, "part")], "qid long, table string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "qid long")
    got = schema_retrieval_prf(run, tables, truth, asked)
    rows = {(r["method"], r["qid"]): r for r in got.collect()}
    assert got.count() == 5 * len(METHODS)
    one = rows["sparse", 1]
    assert (one["num_retrieved"], one["relevant_retrieved"], one["precision"]) == (3, 2, 1.0)
    assert round(one["recall"], 6) == 0.666667
    assert (rows["hybrid", 1]["num_retrieved"], rows["hybrid", 1]["f1"], rows["dense", 2]["num_retrieved"]) == (1, 0.0, 1)
    assert rows["dense", 3]["num_retrieved"] == 0 and rows["sparse", None]["recall"] == 0.0


def test_chunks_come_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a\nb" * 900), (2, None), (3, " ")], "id long, t string")
    from quarry.operators.schema_docs import chunk_sliding
    got = chunk_sliding(docs, "id", "t")
    plan = _plans(got)[1]
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_terms_are_counted_where_the_documents_are(spark, monkeypatch):
    # documents are shuffled whole, once; over more tasks the more tokens there are
    monkeypatch.setattr(B, "COUNTED", 5)
    tokens = B.tokens_of(_few(spark)[0], "id", "t")
    n, mean = B.corpus_stats(tokens)
    post = B.postings(tokens, round(n * mean))
    assert _plans(post)[1].count("Exchange") == 1 and f"], {-(-round(n * mean) // 5)}" in _plans(post)[0]
    assert post.agg(F.sum("tf")).head()[0] == round(n * mean)


def test_buckets_are_counted_over_arrow_buffers(spark):
    v = spark.createDataFrame([(i, ["a"] * i if i % 3 else None) for i in range(600)], "id long, toks array<string>")
    got = v.coalesce(1).select("id", D.bucket_vector("toks").alias("v"))
    assert all(sum(r["v"]) == (r["id"] if r["id"] % 3 else 0) and len(r["v"]) == D.DIM for r in got.collect())


def test_written_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    # Spark reads the rows of a row group together, whatever their size
    import pyarrow.parquet as pq
    monkeypatch.setattr(D, "GROUP", 40)
    vectors = spark.range(0, 1000, 1, 1).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v"))
    files = D.vector_blocks(vectors, "id", "v", 10).inputFiles()
    groups = [m.row_group(i).num_rows for f in files for m in [pq.read_metadata(f.removeprefix("file:"))] for i in range(m.num_row_groups)]
    assert sum(groups) == 100 and max(groups) == 4


def test_dense_hits_of_one_block_are_dealt_by_query(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 10)
    monkeypatch.setattr(Z, "PER_TASK", 10)
    vectors = spark.range(40).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).alias("v"))
    qs = spark.range(0, 300, 1, 1).select(F.col("id").alias("q"), F.array(F.lit(1.0), F.col("id") + 1.0).alias("qv"))
    got = D.dense_topk(vectors, "id", "v", qs, "q", "qv", 3)
    assert "RepartitionByExpression [qid" in _plans(got)[0] and "], 30" in _plans(got)[0]
    assert got.groupBy("qid").agg(F.count("doc").alias("n"), F.max("rank").alias("r")).where("n = 3 AND r = 3").count() == 300
