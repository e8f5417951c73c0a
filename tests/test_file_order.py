"""Splits in file order, and the rollup over arriving files."""

import json

from pyspark.sql import functions as F

from quarry.session import path_exists
from quarry.sources import files as FL
from quarry.streaming.rollup import OUTCOME_SCHEMA, rollup_stream


def _entries(lo, hi):
    return [{"db_id": f"db{i % 3}", "question": f"q{i}", "query": f"SELECT {i}"} for i in range(lo, hi)]


def _known(spark):
    return spark.createDataFrame([("db0",), ("db1",)], "db_id string")


def _want(entries, limit):
    """First entries, then those of known databases; a limit of 0 is none."""
    return [e["question"] for e in (entries[:limit] if limit else entries) if e["db_id"] != "db2"]


def test_first_of_several_line_files(spark, tmp_path):
    every = _entries(0, 3000)
    for i, (lo, hi) in enumerate(((0, 40), (40, 2500), (2500, 2501), (2501, 3000))):
        (tmp_path / f"part-{i}.json").write_text("\n".join(map(json.dumps, every[lo:hi])) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # files are read in parts
    try:
        assert spark.read.json(str(tmp_path)).rdd.getNumPartitions() > 4
        for limit in (None, 0, 1, 40, 41, 1000, 2501, 2600, 9999):
            got = FL.load_split(spark, str(tmp_path), _known(spark), limit)
            assert sorted(r["question"] for r in got.collect()) == sorted(_want(every, limit)), limit
        assert got.columns == ["db_id", "question", "query", "hardness"] and got.first()["hardness"] == "unknown"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_of_array_files(spark, tmp_path):
    every = _entries(0, 500)
    for i, (lo, hi) in enumerate(((0, 200), (200, 200), (200, 500))):
        (tmp_path / f"{i}.json").write_text(json.dumps(every[lo:hi], indent=1))
    for limit in (1, 200, 201, 500):
        got = FL.load_split(spark, str(tmp_path), _known(spark), limit, multi_line=True)
        assert sorted(r["question"] for r in got.collect()) == sorted(_want(every, limit))
    cases = FL.load_test_cases(spark, str(tmp_path), 3, multi_line=True)
    assert [r["question"] for r in cases.collect()] == ["q0", "q1", "q2"]
    assert cases.first()["query_type"] == "unknown"


def test_each_task_keeps_its_first(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, _entries(0, 50))))
    plan = FL.read_first(spark, str(tmp_path), FL.EXAMPLE_SCHEMA, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def _outcomes(spark, path, ids):
    rows = spark.createDataFrame([(f"d{i % 2}", i, "p", i % 3 == 0) for i in ids],
                                 "db_id string, id long, pipeline string, correct boolean")
    have = set(rows.columns)
    full = rows.select(*[F.col(n) if n in have else F.lit(v).alias(n) for n, v in (
        ("db_id", None), ("id", None), ("pipeline", None), ("correct", None), ("hardness", "easy"), ("valid", True),
        ("exact_set_match", False), ("select_match", True), ("from_match", True), ("where_match", True),
        ("groupby_match", True), ("orderby_match", True), ("execution_time", 1.0), ("generated_sql", "SELECT 1"),
        ("question", "q"))])
    full.repartition(3).write.mode("append").json(path)


def test_rollup_goes_on_over_new_files(spark, tmp_path):
    src, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    (tmp_path / "in").mkdir()
    assert rollup_stream(spark, src, state, out).count() == 0 and not path_exists(spark, out)
    assert len(OUTCOME_SCHEMA.split(",")) == 15
    _outcomes(spark, src, range(10))
    one = {r["db_id"]: (r["total"], r["correct"], r["total_time"]) for r in rollup_stream(spark, src, state, out).collect()}
    assert one == {"d0": (5, 2, 5.0), "d1": (5, 2, 5.0)}
    _outcomes(spark, src, range(10, 14))
    for _ in range(2):  # the second run meets no new file
        two = {r["db_id"]: (r["total"], r["correct"]) for r in rollup_stream(spark, src, state, out).collect()}
        assert two == {"d0": (7, 3), "d1": (7, 2)}
