"""The registered corpus queries: names, columns, and their SQL where they have any."""

import duckdb
import pytest

from quarry.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": {"page_id", "host", "n_lines", "n_dropped", "text"},
    "op2_licenses": {"doc_id", "n_matches", "licenses", "spans", "containment"},
    "op3_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_ctw": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_ann": {"query_id", "rank", "vec_id", "score"},
    "op12_conversations": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}
# Queries that do not return a row for each row of their table.
ROWS = {
    "op11_ann": lambda spark: 20 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count(),
    "op12_conversations": lambda spark: spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count(),
}


def test_one_query_an_operator():
    assert set(registry.all_queries()) == set(COLUMNS)
    assert set(registry.all_oracles()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = registry.all_queries()[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    if name == "op13_collocations":
        assert df.groupBy("lang").count().where("count > 2000").count() == 0
        return
    if name in ROWS:
        assert df.count() == ROWS[name](spark)
        return
    table = {"op1_line_dedup": "pages", "op5_vectors": "embeddings"}.get(name, "documents")
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(registry.all_oracles()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.all_oracles()[name])
    cols = [c[0] for c in want.description]
    df = registry.all_queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want.fetchall())
