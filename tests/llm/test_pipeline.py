import random

import corpus_pipeline
from quarry.llm import decontaminate, jaccard
from quarry.llm.common import materialize
from tests.llm.helpers import BENCH, DOC, LABEL
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import check as check_mix


def sf_folder(spark, tmp_path, rows, labels, bench):
    for name, data, schema in (("documents", rows, DOC), ("labels", labels, LABEL), ("benchmark", bench, BENCH)):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def planted():
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    item = text(30)
    rows = [(i, f"{text(30)}\nshared menu line\n{text(rnd.randrange(20, 60))}", "en", f"s{i % 4}", 0) for i in range(300)]
    toxic = [(1000 + i, f"{text(20)} you scum idiot {text(15)}", "en", "s1", 0) for i in range(120)]
    near = [(2000 + i, rows[i][1] + " tail", "en", "s2", 0) for i in range(40)] + [(3000, rows[5][1], "en", "s3", 0)]
    leak = [(4000 + i, f"{text(20)} {' '.join(item.split()[5:20]).upper()} {text(9)}", "en", "s0", 0) for i in range(5)]
    odd = [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (None, text(12), "en", None, 1)]
    labels = [(i, 1, 0) for i in range(0, 300)] + [(1000 + i, 0, 1) for i in range(100)]
    return rows + toxic + near + leak + odd, labels, [(1, item), (2, None)], rows


def test_stages_on_planted_cases(spark, tmp_path):
    rows, labels, bench, clean = planted()
    sf = sf_folder(spark, tmp_path, rows, labels, bench)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "t-" + name)
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = out.collect()
        docs = out
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}
    assert not any(i is not None and 1000 <= i < 2000 for i in ids["toxicity"])
    assert len(ids["toxicity"]) == len(rows) - 120
    assert sorted(map(str, ids["line_dedup"])) == sorted(map(str, ids["toxicity"]))
    assert not any("shared menu line" in (r["text"] or "") for r in kept["line_dedup"])
    before = [(r["doc_id"], r["text"]) for r in kept["line_dedup"] if r["doc_id"] is not None]
    want = {c for _, n, c in components(before) if n} | {d for d, n, _ in components(before) if not n}
    assert {i for i in ids["jaccard_join"] if i is not None} == want
    assert set(range(300)) <= set(ids["jaccard_join"])
    assert {r[0] for r in clean} <= set(ids["decontamination"])
    assert not any(i is not None and 4000 <= i < 5000 for i in ids["decontamination"])
    assert len(ids["decontamination"]) == len(ids["jaccard_join"]) - 5
    assert all(r["taken"] > 0 for r in kept["mixing"])
    mixed = {r["doc_id"]: r for r in kept["mixing"]}
    from quarry.llm import mixing
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    full = mixing.mix_documents(spark.createDataFrame(kept["decontamination"], DOC), lab).collect()
    check_mix(full)
    assert {r["doc_id"]: r["taken"] for r in full if r["taken"]} == {k: r["taken"] for k, r in mixed.items()}


def test_run_on_given_and_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "lang", "source", "size", "source_size", "target", "taken"} <= set(out.columns)
    assert out.count() > 0
    assert corpus_pipeline.run(spark, sf_folder(spark, tmp_path, [], [], [])).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    assert decontaminate.WINDOW == 10 and jaccard.SHINGLE == 5


def test_mix_returns_the_cleaned_texts(spark, tmp_path):
    """Null and repeated ids, repeated rows and equal keys: every taken row has its own text."""
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    rows = [(i, f"{text(25)}\nshared menu line\n{text(20)}", "en", f"s{i % 3}", 0) for i in range(90)]
    rows += [(None, text(30), "en", "s0", 0) for _ in range(30)] + [(7, text(30), "en", "s1", 0) for _ in range(9)]
    labels = [(i, i % 2, 0) for i in range(0, 90)]
    sf = sf_folder(spark, tmp_path, rows, labels, [(1, text(30))])
    out = [r for r in corpus_pipeline.run(spark, sf).collect()]
    clean = {t.replace("\nshared menu line", "") for _, t, *_ in rows}
    assert out and {r["text"] for r in out} <= clean and len({r["text"] for r in out}) == len(out)
    assert all(r["size"] == len(r["text"].split()) and r["n_chars"] == len(r["text"]) for r in out)
    for s in {r["source"] for r in out}:
        of = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in of) == int(of[0]["target"])


def test_copies_within_a_source_leave_one(spark, tmp_path):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(9000)}" for _ in range(n))
    page = f"{text(20)}\n{text(20)}"
    rows = [(i, f"{text(25)}\nshared menu line\n{text(20)}", "en", "s0", 0) for i in range(60)]
    rows += [(100 + i, page, "en", "s0", 0) for i in range(30)]
    sf = sf_folder(spark, tmp_path, rows, [], [(1, text(30))])
    out = corpus_pipeline.drop_boilerplate_lines(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert [r["text"] for r in out if r["doc_id"] >= 100] == [page] * 30
    assert not any("shared menu line" in r["text"] for r in out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf), "c-" + name)
    assert [r["doc_id"] for r in docs.collect() if r["text"] == page] == [100]
