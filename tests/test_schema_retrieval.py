"""Schema retrieval of E13 and E24: by vectors, alone or fused with BM25."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import schema_docs as S
from quarry.operators.dense import hashed_vector

DOCS = [(0, "CREATE TABLE orders (o_orderkey bigint, o_custkey bigint)", "orders"),
        (1, "Table part with columns: p_partkey, p_name", "part"),
        (2, "CREATE TABLE nation (n_nationkey bigint, n_regionkey bigint)", "nation"),
        (3, "SQL Pattern: Count all records in a table", None),
        (4, "SQL Pattern: Order and limit results", None),
        (5, "Table nation with columns: n_nationkey, n_regionkey", "nation"),
        (6, "CREATE TABLE lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint)", "lineitem")]
QUESTIONS = [(1, "p_name of a part"), (2, "zzz yyy"), (3, "count records of nation"), (3, "l_orderkey lineitem"),
             (4, None), (None, "orders o_custkey")]


@pytest.fixture
def tables(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "pos long, content string, table string")
    monkeypatch.setattr(S, "schema_docs", lambda t, values=True: docs)
    monkeypatch.setattr(S, "schema_columns", lambda t: docs.where("table IS NOT NULL").select("table"))
    return SimpleNamespace(spark=spark), spark.createDataFrame(QUESTIONS, "qid long, question string")


def near(spark, text, k):
    """The k documents nearest by their vectors, every pair computed."""
    texts = spark.createDataFrame([(-1, text), *((d[0], d[1]) for d in DOCS)], "i long, t string")
    v = {r["i"]: np.array(r["v"]) for r in texts.select("i", hashed_vector("t").alias("v")).collect()}
    u = {i: x / (np.linalg.norm(x) + 1e-10) for i, x in v.items()}
    return sorted((i for i in u if i >= 0), key=lambda i: (-round(float(u[-1] @ u[i]), 9), i))[:k]


def test_the_agent_retrieves_by_vectors(spark, tables):
    t, q = tables
    got = {r["qid"]: r["tables"] for r in S.retrieved_tables(t, q, "qid", "question", hybrid=False, k=2).collect()}
    asked = {1: "p_name of a part", 2: "zzz yyy", 3: "count records of nation l_orderkey lineitem", 4: ""}
    defined = {i: table for i, content, table in DOCS if content.startswith("CREATE")}
    assert got == {i: sorted(defined[d] for d in near(spark, text, 2) if d in defined) for i, text in asked.items()}
    edges = S.retrieved_schema_fks(t, q, "qid", "question")
    # no word of question 2 is in a document, it has near ones all the same
    assert {2, 4} <= {r["qid"] for r in edges.collect()} <= {1, 2, 3, 4}


def test_the_pipeline_retrieves_by_vectors_and_words(tables):
    t, q = tables
    got = {(r["qid"], r["fallback"]): r["tables"] for r in S.retrieval_fallback(t, q, "qid", "question").collect()}
    assert "part" in got[1, False]  # a description names its table too
    assert got[2, False] and got[4, False]
    assert got[None, True] == ["lineitem", "nation", "orders", "part"]
    assert S.retrieval_fallback(t, q, "qid", "question").where(F.col("qid") == 3).count() == 2


def test_nothing_to_retrieve_gives_the_whole_schema(spark, tables, monkeypatch):
    t, q = tables
    patterns = spark.createDataFrame(DOCS[3:5], "pos long, content string, table string")
    monkeypatch.setattr(S, "schema_docs", lambda t, values=True: patterns)
    got = S.retrieval_fallback(t, q, "qid", "question").collect()
    assert len(got) == len(QUESTIONS) and all(r["fallback"] and len(r["tables"]) == 4 for r in got)
