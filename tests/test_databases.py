"""C11 over several databases: names are matched by a join on the database."""

import re

from pyspark.sql import functions as F

from quarry.functions import sqltext as ST


def _reference(sql, tables):
    low = sql.lower()
    return sorted({t for t in tables if any(re.search(p, low) for p in (
        rf"\bfrom\s+{t}\b", rf"\bjoin\s+{t}\b", rf"\b{t}\s+as\b", rf"\b{t}\."))})


SQLS = ["SELECT * FROM a", "select a.x, b.y from A join b on a.i = b.i", "SELECT * FROM c AS d JOIN\n e as f ON d.x=f.x",
        "from from a", "SELECT a as as as, b . x FROM ab, c", "", "SELECT x FROM (SELECT 1) b", "join join\tjoin c. a.b.c"]
DBS = {"one": ["a", "B", "as"], "two": ["b", "c", "join", "e"], "three": ["ab", "d", "x"]}


def _tables(spark):
    log = [(i * 10 + j, db, sql) for i, sql in enumerate(SQLS) for j, db in enumerate([*DBS, "absent", None])] + [(999, "one", None)]
    return (spark.createDataFrame(log, "qid int, db_id string, sql string"),
            spark.createDataFrame([(d, t) for d, ts in DBS.items() for t in ts] * 2, "db_id string, table string"))


def test_each_database_has_its_own_tables(spark):
    log, catalog = _tables(spark)
    rows = {r["qid"]: r["relevant_tables"] for r in ST.relevant_tables_of(log, "sql", catalog).collect()}
    assert len(rows) == log.count()
    for r in log.collect():
        tables = [t.lower() for t in DBS.get(r["db_id"], [])]
        assert rows[r["qid"]] == (_reference(r["sql"], tables) if r["sql"] else []), r
    assert rows[10] != rows[11]  # one text, two databases


def test_work_grows_with_the_names_used(spark):
    log, catalog = _tables(spark)
    many = catalog.unionByName(spark.range(5000).select(F.lit("one").alias("db_id"), F.concat(F.lit("t"), "id").alias("table")))
    out = ST.relevant_tables_of(log, "sql", many)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {r["qid"]: r["relevant_tables"] for r in out.collect()}[0] == ["a"]
