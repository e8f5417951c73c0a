"""Plan assertions: pushdown, partial top-k, no Python in the text path."""

from quarry.registry import all_queries

from .conftest import SF_SMALL

Q = all_queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_pushed_into_scan(spark):
    p = _plan(Q["filter_eq"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in p
    # column pruning: only the three needed columns are read
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in p


def test_topk_uses_partial_window_limit(spark):
    df = Q["sparse_topk"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in final


def test_text_functions_stay_on_jvm(spark):
    for key in ("extract_sql", "clean_sql", "component_match", "score_overall", "hardness"):
        p = _plan(Q[key](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key


def test_dimension_join_is_broadcast(spark):
    df = Q["multi_join_hard"](spark, SF_SMALL)
    df.collect()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_per_group_limits_are_partial(spark):
    for key in ("stratified_sample", "first_success_attempt", "sparse_topk"):
        p = _plan(Q[key](spark, SF_SMALL))
        assert "WindowGroupLimit" in p, key


def test_dense_topk_meets_written_blocks(spark):
    # both sides are written in blocks; the source is read once, for the blocks
    p = _plan(Q["dense_topk"](spark, SF_SMALL))
    assert p.count("MapInPandas") == 1 and "embeddings.parquet" not in p and "WindowGroupLimit" in p


def test_bm25_scores_read_written_postings(spark):
    df = Q["sparse_topk"](spark, SF_SMALL)
    p = _plan(df)
    # the corpus is read once, for the index; ranking reads what is written
    assert "sparse-" in p and "documents.parquet" not in p  # paths are truncated in plan text


def test_words_left_out_are_computed_once_a_statement(spark):
    # the filter over a statement's words is given them, it does not hold their regular expressions
    for key in ("compare_sql", "extract_columns"):
        p = _optimized(Q[key](spark, SF_SMALL))
        assert "array_contains(lambda" in p and "array_contains(concat(" not in p, key
