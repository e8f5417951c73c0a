"""E5 with a model of one's own, and the vector store in segments."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.dense import dense_topk, embedded
from quarry.operators.hybrid import hybrid_topk
from quarry.sources.vector_store import VectorStore

TEXTS = [(1, "aab"), (2, None), (3, ""), (4, "bbbb"), (5, "ab"), (6, "cab")]


def letters(note=None):
    """Makes a model that counts the letters a, b, c, and notes what it is given."""
    def make():
        if note:
            with open(note, "a") as f:
                f.write("made\n")

        def model(texts):
            assert 0 < len(texts) <= 2 and None not in texts
            return [[t.count(x) for x in "abc"] for t in texts]
        return model
    return make


def test_a_model_of_ones_own(spark, tmp_path):
    note = str(tmp_path / "note")
    df = spark.createDataFrame(TEXTS, "id long, t string").withColumn("v", F.lit("clash")).coalesce(1)
    got = {r["id"]: r["v"] for r in embedded(df, "t", letters(note), batch=2).collect()}
    assert got == {1: [2.0, 1.0, 0.0], 2: None, 3: [0.0] * 3, 4: [0.0, 4.0, 0.0], 5: [1.0, 1.0, 0.0], 6: [1.0, 1.0, 1.0]}
    assert open(note).read() == "made\n"  # one task, one model
    os.remove(note)
    assert embedded(df.where("t IS NULL"), "t", letters(note), batch=2).collect()[0]["v"] is None and not os.path.exists(note)


def test_a_wrong_model_is_an_error(spark):
    df = spark.createDataFrame(TEXTS, "id long, t string")
    with pytest.raises(Exception, match="vectors for"):
        embedded(df, "t", lambda: lambda texts: [[1.0]] * (len(texts) + 1)).collect()


def test_hashed_by_default(spark):
    df = spark.createDataFrame(TEXTS, "id long, t string")
    assert all(len(r["v"]) == 64 for r in embedded(df, "t").collect())


def test_dense_and_hybrid_use_it(spark):
    docs = spark.createDataFrame([x for x in TEXTS if x[1]], "id long, t string")
    qs = spark.createDataFrame([(7, "aaab"), (8, "b")], "q long, t string")
    dv, qv = embedded(docs, "t", letters(), 2), embedded(qs, "t", letters(), 2, "qv")
    top = {(r["qid"], r["rank"]): r["doc"] for r in dense_topk(dv, "id", "v", qv, "q", "qv", 2).collect()}
    assert top[7, 1] == 1 and top[8, 1] == 4
    hits = hybrid_topk(docs, "id", "t", qs, "q", "t", 1, embedder=letters())
    assert {(r["qid"], r["doc"]) for r in hits.collect()} == {(7, 1), (8, 4)}


def _batch(spark, rows):
    return spark.createDataFrame(rows, "i long, c string, db string, v array<double>")


def _add(store, df, ids="i"):
    return store.add(df, ids, "c", "db", "v", "i")


def test_batches_are_appended(spark):
    store = VectorStore(spark)
    assert len(store) == 0 and store.load() is None and store.get().collect() == []
    _add(store, _batch(spark, [(1, "one", "d", [3.0, 4.0]), (2, "two", "e", [0.0, 2.0])]))
    before = {p: os.stat(p).st_mtime_ns for p in _files(store)}
    again = _add(VectorStore(spark, store.path), _batch(spark, [(2, "new", "e", [1.0, 0.0]), (9, "nine", "d", [1.0, 0.0])]))
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items())  # the first batch was not touched
    _add(again, _batch(spark, [(5, "x", "d", [1.0, 1.0])]), ids=None)
    got = {r["id"]: (r["seq"], r["content"]) for r in again.get().collect()}
    assert got == {"1": (0, "one"), "2": (2, "new"), "9": (3, "nine"), "doc_4": (4, "x")}
    assert len(again) == 5
    ids = spark.createDataFrame([("2",), ("none",)], "id string")
    assert [(r["id"], r["content"]) for r in again.get(ids).collect()] == [("2", "new")]


def _files(store):
    root = f"{store.path}/vectors".removeprefix("file:")
    return [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")]


def test_merge_clear_and_failed_batches(spark):
    store = VectorStore(spark)
    _add(store, _batch(spark, [(1, "one", "d", [3.0, 4.0]), (2, "two", "e", [0.0, 2.0])]))
    _add(store, _batch(spark, [(2, "new", "e", [1.0, 0.0])]))
    with pytest.raises(Exception, match="no vector"):
        _add(store, _batch(spark, [(7, "bad", "d", None)]))
    assert len(store) == 3 and {r["id"] for r in store.get().collect()} == {"1", "2"}
    latest = sorted(map(tuple, store.get().collect()))
    store.merge()
    assert len(store) == 2 and sorted(map(tuple, store.get().collect())) == latest
    _add(store, _batch(spark, [(8, "z", "d", [1.0, 0.0])]))
    assert {r["id"]: r["seq"] for r in store.get().collect()} == {"1": 0, "2": 2, "8": 3}
    store.clear()
    assert len(store) == 0 and store.load() is None
    _add(store, _batch(spark, [(8, "z", "d", [1.0, 0.0])]))
    assert [r["seq"] for r in store.get().collect()] == [0]
