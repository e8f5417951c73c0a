"""Hand-computed micro tables: comparison edge cases, keyword traps, ties, skew."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as SC
from quarry.functions import sqltext as ST
from quarry.operators import compare as CMP
from quarry.operators.hybrid import minmax_normalize
from quarry.operators.ordinal import with_ordinal


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ D1 - D5
@pytest.fixture(scope="module")
def result_rows(spark):
    # q1: same set, different multiplicity; q2: gen empty; q3: both empty;
    # q4: column order swapped values; q5: NULL values; q6: same rows, other order
    data = [
        ("gen", 1, 1, 2.0, 1), ("gen", 1, 1, 2.0, 2), ("gold", 1, 1, 2.0, 1),
        ("gold", 2, 5, 1.0, 1),
        ("gen", 4, 2, 1.0, 1), ("gold", 4, 1, 2.0, 1),
        ("gen", 5, None, 3.0, 1), ("gold", 5, None, 3.0, 1),
        ("gen", 6, 1, 1.0, 1), ("gen", 6, 2, 2.0, 2), ("gold", 6, 2, 2.0, 1), ("gold", 6, 1, 1.0, 2),
    ]
    rows = spark.createDataFrame(data, "side string, question long, a long, b double, ord long")
    qs = spark.createDataFrame([(i,) for i in range(1, 7)], "q long")
    return rows, qs


def test_exact_set_match_edges(result_rows):
    rows, qs = result_rows
    out = dict(_rows(CMP.exact_set_match(rows, ["a", "b"], qs), "question", "exact_set_match"))
    assert out[1] is True            # duplicates collapse
    assert out[2] is False           # one side empty
    assert out[3] is True            # both empty
    # sorted stringified values: (2, 1.0) -> ['1.0', '2'] vs (1, 2.0) -> ['1', '2.0']
    assert out[4] is False
    assert out[5] is True            # NULL -> 'None' on both sides
    assert out[6] is True            # order ignored


def test_multiset_and_ordered(result_rows):
    rows, qs = result_rows
    bag = dict(_rows(CMP.multiset_match(rows, ["a", "b"], qs), "question", "multiset_match"))
    assert bag[1] is False and bag[3] is True and bag[6] is True
    ordered = dict(_rows(CMP.ordered_match(rows, ["a", "b"], ["ord"], qs), "question", "ordered_match"))
    assert ordered[6] is False       # same rows, different order
    assert ordered[5] is True
    assert ordered[3] is False       # empty never matches in order


def test_jaccard_and_prf(result_rows):
    rows, qs = result_rows
    j = {r["question"]: r for r in CMP.jaccard_match(rows, ["a", "b"], qs).collect()}
    assert j[3]["jaccard"] == 1.0 and j[2]["jaccard"] == 0.0
    assert j[1]["result1_count"] == 2 and j[1]["result2_count"] == 1
    p = {r["question"]: r for r in CMP.overlap_prf(rows, ["a", "b"], qs).collect()}
    assert (p[3]["precision"], p[3]["recall"], p[3]["f1"]) == (1.0, 1.0, 1.0)
    assert (p[2]["precision"], p[2]["recall"], p[2]["f1"]) == (0.0, 0.0, 0.0)
    assert p[4]["f1"] == 0.0 and p[1]["execution_match"] is False


# ------------------------------------------------------------------ C keyword traps
def test_question_type_substring_trap(spark):
    df = spark.createDataFrame([("Which country is largest?",), ("How many singers?",),
                                ("List all names",)], "q string")
    got = [r[0] for r in df.select(ST.question_type("q")).collect()]
    # "country" contains "count" -> COUNT (substring rule kept on purpose)
    assert got == ["COUNT", "COUNT", "SELECT"]


def test_hardness_rules(spark):
    df = spark.createDataFrame([
        ("SELECT a FROM t",), ("SELECT a FROM t JOIN u ON t.x = u.x",),
        ("SELECT a FROM t WHERE a IN (SELECT b FROM u)",), ("SELECT a, count(*) FROM t GROUP BY a",),
        ("SELECT a FROM t JOIN u ON 1 JOIN v ON 1",), ("SELECT a FROM t UNION SELECT b FROM u",)], "s string")
    got = [r[0] for r in df.select(ST.hardness("s")).collect()]
    assert got == ["easy", "medium", "hard", "medium", "hard", "hard"]


def test_extract_sql_priority_and_fence(spark):
    df = spark.createDataFrame([
        ("```sql\nSELECT 1;\n```",),
        ("First INSERT INTO t SELECT 2; then more",),
        ("nothing here",),
    ], "r string")
    got = [r[0] for r in df.select(ST.extract_sql("r")).collect()]
    # SELECT outranks INSERT by priority, not position
    assert got == ["SELECT 1;", "SELECT 2;", "nothing here"]


def test_clean_and_validate(spark):
    df = spark.createDataFrame([("  ```sql\nselect  a\nfrom t;;\n```  ",), ("",), ("SELECT (a FROM t",)], "s string")
    out = df.select(ST.clean_sql("s").alias("c")).select("c", ST.validate_error("c").alias("e")).collect()
    assert out[0]["c"] == "select a from t;" and out[0]["e"] is None
    assert out[1]["e"] == "Empty SQL query"
    assert out[2]["e"] == "Unbalanced parentheses"


def test_scores(spark):
    df = spark.createDataFrame([("SELECT count(*) FROM t AS x JOIN u ON 1;", "How many rows?", True, 3)],
                               "s string, q string, ok boolean, n long")
    r = df.select(SC.score_syntax("s").alias("syn"), SC.score_semantic("q", "s", "ok", "n").alias("sem"),
                  SC.score_efficiency("s").alias("eff")).first()
    assert r["syn"] == 1.0
    assert r["sem"] == pytest.approx(0.9)       # 0.5 + 0.25 + 0.15
    assert r["eff"] == 1.0


# ------------------------------------------------------------------ E10 ties, ordinal skew
def test_minmax_all_equal(spark):
    df = spark.createDataFrame([(1, 10, 2.0), (1, 11, 2.0), (2, 10, 1.0), (2, 11, 3.0)],
                               "qid long, doc long, score double")
    got = _rows(minmax_normalize(df), "qid", "doc", "norm")
    assert got == [(1, 10, 1.0), (1, 11, 1.0), (2, 10, 0.0), (2, 11, 1.0)]


def test_ordinal_hot_group_is_split(spark):
    # one group holds 90% of the rows: it must be spread over several partitions
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("g"),
                               F.col("id").alias("k"))
    o = with_ordinal(df, "g", ["k"], partitions=8)
    hot = o.filter(F.col("g") == 99)
    assert hot.agg(F.min("ord"), F.max("ord"), F.countDistinct("ord")).first() == (1, 18000, 18000)
    assert hot.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_feedback_order(spark):
    df = spark.createDataFrame([("SELECT * FROM t LIMIT 3", "What is the average age?", True, None, 2),
                                ("", "How many?", False, "no such table: x", 0)],
                               "s string, q string, ok boolean, e string, n long")
    got = [r[0] for r in df.select(SC.feedback("s", "q", "ok", "e", "n")).collect()]
    assert got[0] == ("Query should end with semicolon | Query executed successfully | Query returned 2 results"
                      " | Consider selecting specific columns instead of * | Good: Uses LIMIT to restrict results")
    assert got[1] == "No SQL query provided | Execution failed: no such table: x | Table name might be incorrect"


def test_dense_local_topk_ties():
    import numpy as np
    from quarry.operators.dense import _local_topk
    s = np.array([[1, 0.5], [1, 0.5], [0.2, 0.9], [1, 0.1]])
    out = _local_topk(s, np.array([30, 10, 20, 5]), np.array([7, 8]), 2)
    assert list(zip(out["qid"], out["doc"])) == [(7, 5), (7, 10), (8, 20), (8, 10)]


def test_split_text_always_advances():
    from quarry.operators.schema_docs import windows
    text = "a\n" + "x" * 600 + "\nend"
    chunks = [w.strip() for w in windows(text, size=500, overlap=50)]
    # the newline at position 1 would make the original step back before its start
    assert chunks[0] == "a"
    assert "".join(c for c in chunks).count("end") == 1
    assert len(chunks) < 10


def test_chunks_stream_out_of_a_lateral_join(spark):
    from quarry.operators.schema_docs import chunk_sliding
    df = spark.createDataFrame([(1, "ab\ncdefgh ij"), (2, None), (3, ""), (4, " \n "), (5, "x" * 100_000)],
                               "id long, text string")
    out = chunk_sliding(df, "id", "text", size=5, overlap=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPythonUDTF" in plan and "pandas" not in plan.lower() and "Join" not in plan
    rows = sorted(tuple(r) for r in out.collect())
    assert [r[1:] for r in rows if r[0] == 1] == [(0, "ab"), (1, "b"), (2, "cdefg"), (3, "fgh i"), (4, "ij")]
    assert {r[0] for r in rows} == {1, 5}
    assert sum(r[0] == 5 for r in rows) == len(range(0, 100_000, 3))


def test_vector_store_ids_and_last_wins(spark):
    from quarry.sources import files as FL
    a = spark.createDataFrame([(1, "one", "db", [1.0, 0.0]), (2, "two", "db", [0.0, 2.0])],
                              "i long, c string, db string, v array<double>")
    b = spark.createDataFrame([("x", "db", [3.0, 4.0], 1), ("y", "db", [1.0, 1.0], 2)],
                              "c string, db string, v array<double>, o long")
    c = spark.createDataFrame([(2, "two-again", "db", [5.0, 0.0])], "i long, c string, db string, v array<double>")
    s = FL.store_add(None, a, "i", "c", "db", "v", "i")
    s = FL.store_add(s, b, None, "c", "db", "v", "o")
    s = FL.store_add(s, c, "i", "c", "db", "v", "i")
    got = {r["id"]: (r["seq"], r["content"]) for r in FL.store_get(s).collect()}
    assert got == {"1": (0, "one"), "doc_2": (2, "x"), "doc_3": (3, "y"), "2": (4, "two-again")}
    v = {r["id"]: r["vector"] for r in FL.store_get(s).collect()}
    assert v["doc_2"] == pytest.approx([0.6, 0.8])


def test_execution_accuracy_outcomes(spark):
    from quarry.operators.execute import execution_accuracy
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string").createOrReplaceTempView("t_exec")
    pairs = [(1, "SELECT v FROM t_exec", "SELECT DISTINCT v FROM t_exec"),      # set match
             (2, "SELECT k FROM t_exec", "SELECT v FROM t_exec"),               # different values
             (3, "SELECT nope FROM t_exec", "SELECT v FROM t_exec"),            # generated fails
             (4, "SELECT v FROM t_exec", "SELECT FROM WHERE")]                  # gold fails
    got = {r["question"]: (r["valid"], r["correct"], (r["error"] or "")[:18])
           for r in execution_accuracy(spark, pairs).collect()}
    assert got[1] == (True, True, "") and got[2] == (True, False, "")
    assert got[3][:2] == (False, False) and got[3][2].startswith("Generated SQL")
    assert got[4][:2] == (False, False) and got[4][2].startswith("Database error")


def test_ordinal_self_join_is_consistent(spark):
    # two plan branches over one numbering must agree (predecessor join finds n - groups pairs)
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    o = with_ordinal(df, "g", ["k"], partitions=8)
    prev = o.select("g", (F.col("ord") + 1).alias("ord"), F.col("k").alias("pk"))
    j = o.join(prev, ["g", "ord"])
    assert j.count() == 5000 - 3
    assert j.filter(F.col("pk") >= F.col("k")).count() == 0


def test_execution_runtime_error_is_captured(spark):
    from quarry.operators.execute import execution_accuracy, guarded_execute
    spark.createDataFrame([("1",), ("x",)], "s string").createOrReplaceTempView("t_rt")
    pairs = [(1, "SELECT CAST(s AS INT) AS v FROM t_rt", "SELECT s FROM t_rt"),   # fails only at run time (ANSI)
             (2, "SELECT s FROM t_rt", "SELECT s FROM t_rt")]
    got = {r["question"]: (r["valid"], r["correct"], r["error"] or "") for r in execution_accuracy(spark, pairs).collect()}
    assert got[2] == (True, True, "")
    assert got[1][0] is False and got[1][2].startswith("Execution error")
    g = {r["question"]: (r["success"], r["n_rows"]) for r in
         guarded_execute(spark, [(1, "SELECT CAST(s AS INT) FROM t_rt"), (2, "SELECT s FROM t_rt")]).collect()}
    assert g == {1: (False, 0), 2: (True, 2)}


def test_dense_topk_string_ids_and_many_query_blocks(spark, monkeypatch):
    import numpy as np
    from quarry.operators import dense as DN
    monkeypatch.setattr(DN, "QUERY_BLOCK", 3)
    monkeypatch.setattr(DN, "DOC_BLOCK", 7)
    rnd = np.random.default_rng(3)
    d, q = rnd.normal(size=(40, 8)), rnd.normal(size=(11, 8))
    d[5] = d[6]  # a tie, broken by id
    docs = spark.createDataFrame([(f"db:{i}", [float(x) for x in v]) for i, v in enumerate(d)], "id string, v array<double>")
    qs = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(q)], "q string, w array<double>")
    got = {}
    for r in DN.dense_topk(docs, "id", "v", qs, "q", "w", 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc"]))
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u(q) @ u(d).T, 9)
    for i in range(len(q)):
        want = sorted(range(40), key=lambda j: (-s[i, j], f"db:{j}"))[:4]
        assert sorted(got[f"q{i}"]) == [(k + 1, f"db:{j}") for k, j in enumerate(want)]


def test_store_of_one_document_goes_on_at_one(spark):
    import pytest
    from quarry.sources import files as FL
    a = spark.createDataFrame([("x", "db", [1.0, 0.0], 1)], "c string, db string, v array<double>, o long")
    one = FL.store_add(None, a, None, "c", "db", "v", "o")
    two = FL.store_add(one, a, None, "c", "db", "v", "o")
    assert _rows(two, "id", "seq") == [("doc_0", 0), ("doc_1", 1)]
    bad = spark.createDataFrame([("x", "db", None, 1)], "c string, db string, v array<double>, o long")
    with pytest.raises(Exception, match="no vector"):
        FL.store_add(None, bad, None, "c", "db", "v", "o").collect()


def test_summary_texts_follow_the_published_report(spark):
    from quarry.sources import files as FL
    names = ["total_questions", "execution_accuracy", "exact_set_match_rate", "avg_component_score", "select_match_rate",
             "from_match_rate", "where_match_rate", "groupby_match_rate", "orderby_match_rate", "avg_time_per_question",
             "total_time"]
    row = [84, 37 / 84, 37 / 84, 0.6071428571428571, 67 / 84, 37 / 84, 19 / 84, 70 / 84, 62 / 84, 2.934, 246.46]
    s = spark.createDataFrame([("Single_Agent", *row)], "pipeline string, total_questions long, " + ", ".join(
        f"{n} double" for n in names[1:]))
    assert list(FL.summary_text(s).head()) == ["Single Agent", 84, "44.0%", "44.0%", "60.7%", "79.8%", "44.0%", "22.6%",
                                               "83.3%", "73.8%", "2.9", "246.5"]


def test_table_names_of_lists_quotes_and_qualifiers(spark):
    from pyspark.sql import functions as F
    from quarry.functions.sqltext import extract_tables
    cases = {"SELECT 1 FROM a, b AS x WHERE y = 1": ["a", "b"], 'SELECT 1 FROM "my_t" t': ["my_t"],
             "SELECT 1 FROM main.t1 JOIN `s`.[t2] ON 1": ["t1", "t2"], "SELECT 1 FROM (SELECT 2 FROM z) q": ["z"],
             "SELECT 'from x' FROM a LEFT JOIN b USING (k)": ["a", "b"], "": [], "DELETE FROM o WHERE k": ["o"]}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", extract_tables("s").alias("t")).collect()}
    assert got == cases
    assert spark.range(1).select(extract_tables(F.lit(None).cast("string"))).head()[0] is None


def test_last_schema_entry_of_a_file_wins(spark, tmp_path):
    from quarry.sources import files as FL
    (tmp_path / "tables.json").write_text(
        '[{"db_id": "a", "table_names_original": ["x"], "more": 1},\n {"db_id": "b", "table_names_original": []},\n'
        ' {"db_id": "a", "table_names_original": ["y", "z"]}]')
    got = {r["db_id"]: r["table_names_original"] for r in FL.load_schema_json(spark, str(tmp_path)).collect()}
    assert got == {"a": ["y", "z"], "b": []}


def test_question_limit(spark):
    from quarry.plans.derived import query_log
    from quarry.plans.reports import load_questions
    from quarry.session import Tables
    from .conftest import SF_SMALL
    log = query_log(Tables(spark, SF_SMALL))
    assert [r["id"] for r in load_questions(log, "1-URGENT", 3).orderBy("id").collect()] == [1, 2, 3]


def test_cluster_without_shared_folder_is_refused():
    import pytest
    from quarry.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_functions_travel_by_value():
    """A task's function unpickles where the package cannot be imported."""
    import pickle
    import subprocess
    import sys
    from pyspark import cloudpickle
    from quarry.operators.schema_docs import windows
    code = "import pickle, sys; f = pickle.loads(bytes.fromhex(sys.argv[1])); print(list(f('a\\nb', 9, 0)))"
    data = cloudpickle.dumps(windows)
    assert list(pickle.loads(data)("a", 9, 0)) == ["a"]
    out = subprocess.run([sys.executable, "-c", code, data.hex()], capture_output=True, text=True, cwd="/", env={
        "PATH": "/usr/bin"})
    assert out.stdout.strip() == str(["a\nb"]), out.stderr


def test_bounded_topk_equals_scoring_all_pairs(spark):
    import random
    from quarry.operators import bm25 as B
    rnd = random.Random(4)
    words = ["the", "of", "and"] * 12 + [f"w{i}" for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(400)],
                                 "id long, t string")
    qs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
                               + [(100, "the of and"), (101, "absent"), (102, "")], "q long, t string")
    tokens = B.tokens_of(docs, "id", "t")
    every = _rows(B.top_k(B.bm25_scores(tokens, qs, "q", "t"), 5), "qid", "doc", "rank")
    assert _rows(B.bm25_topk(tokens, qs, "q", "t", 5), "qid", "doc", "rank") == every


def test_frequent_words_do_not_make_a_pair_table(spark):
    """Completed pairs grow with queries x k, not with queries x documents."""
    from pyspark.sql import functions as F
    from quarry.operators import bm25 as B
    docs = spark.range(3000).select(F.col("id"), F.concat(
        F.lit("the of "), F.concat(F.lit("w"), (F.col("id") % 600).cast("string"))).alias("t"))
    qs = spark.range(50).select(F.col("id").alias("q"), F.concat(F.lit("the of w"), F.col("id").cast("string")).alias("t"))
    seen = []
    total = B._sum
    try:
        B._sum = lambda hit: (seen.append(hit.count()), total(hit))[1]
        assert B.bm25_topk(B.tokens_of(docs, "id", "t"), qs, "q", "t", 5).count() == 250
    finally:
        B._sum = total
    assert max(seen) <= 50 * 5 * 2  # rare terms, two frequent terms of the survivors, no full queries
