"""Catalog counts, smallest values and sample rows."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from quarry.session import Tables
from quarry.sources import profile as P
from quarry.sources.catalog import column_value_sample, profiled_columns, schema_context, table_ddl

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_come_from_footers(spark):
    quick = P.table_counts(P.footer_session(spark).read.parquet(f"{SF_SMALL}/customer.parquet"))
    assert "PushedAggregation: [COUNT(*), COUNT(c_custkey)" in _plan(quick)
    slow = P.table_counts(spark.read.parquet(f"{SF_SMALL}/customer.parquet"))
    assert tuple(quick.first()) == tuple(slow.first())
    # the session asked for keeps its own settings
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_profile_is_written_once_and_again_after_a_change(spark, tmp_path):
    sf = str(tmp_path / "sf")
    shutil.copytree(SF_SMALL, sf)
    t = Tables(spark, sf, register=False)
    one = P.column_profile(t)
    for use in (profiled_columns(t), table_ddl(profiled_columns(t)), schema_context(profiled_columns(t), t)):
        assert use.inputFiles()  # plans read the written counts
        assert "profile-" in _plan(use)
    assert P.column_profile(Tables(spark, sf, register=False)).inputFiles() == one.inputFiles()
    spark.createDataFrame([(900, None)], "r_regionkey int, r_name string").unionByName(
        spark.read.parquet(f"{SF_SMALL}/region.parquet")).write.mode("overwrite").parquet(f"{sf}/region.parquet.new")
    shutil.copytree(f"{sf}/region.parquet.new", f"{sf}/region2")
    (tmp_path / "sf" / "region.parquet").unlink()
    shutil.copytree(f"{sf}/region2", f"{sf}/region.parquet")
    again = P.column_profile(Tables(spark, sf, register=False))
    assert again.inputFiles() != one.inputFiles()
    assert {(r["name"], r["n_rows"], r["n_nulls"]) for r in again.where("`table` = 'region'").collect()} == {
        ("r_regionkey", 6, 0), ("r_name", 6, 1)}


def test_smallest_values_stay_on_the_jvm_behind_a_bound(spark):
    p = _plan(column_value_sample(Tables(spark, SF_SMALL)))
    assert "MapInPandas" not in p and "ArrowEvalPython" not in p
    assert "LessThanOrEqual(c_name" in p and "WindowGroupLimit" in p


def test_smallest_values_equal_brute_force(spark, tmp_path):
    long = ["a" * 300 + f"{i:04d}" for i in range(50)]
    rows = [(None, "x")] * 40 + [(v, "xy"[i % 2]) for i, v in enumerate(long * 3)]
    rows += [(f"b{i:05d}", None) for i in range(4000)] + [("", "")]
    rows.reverse()  # the smallest values come last, behind the first thousand rows
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "`odd name` string, few string").repartitionByRange(8, F.desc("odd name")).write.option(
        "parquet.block.size", 4096).parquet(path)
    df = spark.read.parquet(path)
    got = P.smallest_values({"t": (df, ["odd name", "few"])}, 20)
    want = {("t", "odd name", v) for v in sorted({r[0] for r in rows if r[0] is not None})[:20]}
    want |= {("t", "few", v) for v in ("", "x", "y")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    none = spark.createDataFrame([], "`odd name` string, few string")
    assert P.smallest_values({"t": (none, ["odd name", "few"])}, 20).count() == 0


def test_bound_is_never_below_its_text():
    last = chr(0x10FFFF)
    for v in ("", "abc", "a" * 200, "a" * 201, "a" * 199 + "\U0001F600" * 9, "a" * 200 + last * 3):
        b = P._bound_text(v)
        assert b.encode() >= v.encode()


def test_rows_read_as_python_shows_them(spark):
    rows = [(1, "it's", 1.5, True, dt.datetime(2020, 1, 2, 3, 4, 5), [0.25, 1.0]),
            (2, 'say "it\'s"\n\\', -0.1, False, None, []), (3, None, None, None, None, None), (None, "no key", 0.0, True, None, [])]
    df = spark.createDataFrame(rows, "k long, s string, x double, b boolean, ts timestamp_ntz, v array<double>")
    got = P.first_rows(df, ["k"], 5).first()["rows"]
    shown = []
    for r in rows[:3]:
        d = dict(zip(df.columns, r, strict=True))
        d["ts"] = d["ts"] and str(d["ts"])
        shown.append(str(d))
    assert got == shown
    assert P.first_rows(df, ["k"], 1).first()["rows"] == shown[:1]
    assert P.first_rows(df.limit(0), ["k"], 2).first()["rows"] == []


def test_equal_keys_are_ordered_by_row_and_lookups_are_pushed(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k long, s string")
    assert P.first_rows(df, ["k"], 2).first()["rows"] == ["{'k': 1, 's': 'a'}", "{'k': 1, 's': 'b'}"]
    t = Tables(spark, SF_SMALL)
    assert "LessThanOrEqual(c_custkey" in _plan(P.first_rows(t.customer, ["c_custkey"], 2))
