"""D1-D5 on results whose questions have columns of their own."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import compare as CMP
from quarry.plans.derived import result_shapes
from quarry.session import Tables


def _results(spark, pairs):
    """One question a pair; each side a list of SQL rows."""
    rows = None
    for q, sides in enumerate(pairs):
        for side, selects in zip(("gen", "gold"), sides, strict=True):
            for n, sql in enumerate(selects):
                df = spark.sql(sql)
                one = df.select(F.lit(side).alias("side"), F.lit(q).alias("question"),
                                CMP.packed({c: F.col(c) for c in df.columns}).alias("row"), F.lit(n).alias("ord"))
                rows = one if rows is None else rows.unionByName(one)
    return rows, spark.range(len(pairs)).select(F.col("id").cast("int").alias("q"))


PAIRS = [
    (["SELECT 1 AS a, 2.0D AS b"], ["SELECT 1L AS a, 2 AS b"]),                      # 0 numbers by value
    (["SELECT '1' AS a"], ["SELECT 1 AS a"]),                                         # 1 text and number
    (["SELECT 1 AS a"], ["SELECT 1 AS x"]),                                           # 2 other names
    (["SELECT 1 AS a, 2 AS b"], ["SELECT 2 AS b, 1 AS a"]),                           # 3 other order of columns
    (["SELECT 1 AS a"], ["SELECT 1 AS a, CAST(NULL AS STRING) AS b"]),                # 4 a column missing
    (["SELECT NULL AS a"], ["SELECT 'None' AS a"]),                                   # 5 NULL and its text
    (["SELECT CAST(1.50 AS DECIMAL(9,4)) AS a"], ["SELECT 1.5D AS a"]),               # 6 decimal and double
    (["SELECT true AS a"], ["SELECT 1 AS a"]),                                        # 7 boolean and number
    (["SELECT DATE'2020-01-02' AS a"], ["SELECT '2020-01-02' AS a"]),                 # 8 date and text
    (["SELECT 1 AS a", "SELECT 2 AS a"], ["SELECT 2 AS a", "SELECT 1 AS a"]),         # 9 other order of rows
    (["SELECT 9007199254740993L AS a"], ["SELECT 9007199254740992L AS a"]),           # 10 beyond the doubles
    (["SELECT 'a\u0001b' AS a, 'c' AS b"], ["SELECT 'a' AS a, 'b\u0001c' AS b"]),     # 11 the separator in a value
]


@pytest.fixture(scope="module")
def results(spark):
    rows, qs = _results(spark, PAIRS)
    return rows.cache(), qs


def _column(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["question"])]


def test_bags_by_name_and_value(results):
    got = _column(CMP.multiset_match(results[0], "row", results[1]), "multiset_match")
    assert got == [True, False, False, True, False, False, True, True, True, True, False, False]


def test_sets_of_texts(results):
    got = _column(CMP.exact_set_match(results[0], "row", results[1]), "exact_set_match")
    assert got[1:6] == [True, True, True, False, True] and not got[0] and got[9]


def test_overlap_and_jaccard(results):
    p = _column(CMP.overlap_prf(results[0], "row", results[1]), "f1")
    j = _column(CMP.jaccard_match(results[0], "row", results[1]), "jaccard")
    assert p == j == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0]


def test_order(results):
    out = CMP.ordered_match(results[0], "row", ["ord"], results[1])
    assert _column(out, "ordered_match") == [True, False, True, False, False, False, True, True, True, False, False, False]
    assert _column(out, "ordered_named_match") == [True, False, False, True, False, False, True, True, True, False, False, False]


def test_value_texts(spark):
    values = [(1, 1.0), (0, -0.0), (10**17, 1e17), (Decimal("2.500"), 2.5), (True, 1), (datetime.date(2020, 1, 2), "2020-01-02")]
    for a, b in values:
        df = spark.createDataFrame([(a,)], ["v"]).select(CMP.value_text(F.to_json(F.col("v").cast("variant"))).alias("t"))
        other = spark.createDataFrame([(b,)], ["v"]).select(CMP.value_text(F.to_json(F.col("v").cast("variant"))).alias("t"))
        assert df.head() == other.head(), (a, b)


def test_given_shapes_differ(spark):
    rows = result_shapes(Tables(spark, "/root/testdata/sf0.001"))
    names = F.transform("row", lambda x: x["name"])
    assert rows.select(names.alias("n")).distinct().count() == 4
    kinds = rows.select(F.explode("row").alias("c")).select("c.name", F.schema_of_variant("c.value").alias("t")).distinct()
    assert kinds.count() >= 8
