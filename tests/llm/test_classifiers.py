import pytest

from quarry.llm import quality, toxicity
from quarry.llm.labelled import labelled_sample
from tests.llm.helpers import LABEL, crc, doc_rows, docs, empty_docs

SF = "/root/testdata/sf0.1"


def rates(rows, labels, held):
    """(caught share of label 1, wrongly flagged share of label 0) on held-out rows."""
    r = [(x["predicted"], labels[x["doc_id"]]) for x in rows if x["held_out"] is held and x["doc_id"] in labels]
    ones, zeros = [p for p, y in r if y == 1], [p for p, y in r if y == 0]
    return sum(ones) / len(ones), sum(zeros) / len(zeros)


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op10_toxicity(spark, SF).collect()
    lab = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    caught, wrong = rates(rows, lab, True)
    assert caught > 0.75 and wrong < 0.01


def test_quality_on_held_out_rows(spark):
    rows = quality.op6_quality(spark, SF).collect()
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in rows)
    good, bad = rates(rows, lab, True)
    assert good > 0.98 and bad < 0.1
    assert 0.85 < sum(r["kept"] for r in rows) / len(rows) <= 1


def test_training_rows_are_outside_the_fold(spark):
    d = docs(spark, [(i, f"text {i % 40}", "en", "a", 1) for i in range(200)])
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(3, 0, 1), (None, 1, 1), (9, None, None)], LABEL)
    s = labelled_sample(d, lab, "toxic", 3, 1).collect()
    assert all(crc(r["doc_id"], 3) != 1 for r in s) and len({r["text"] for r in s}) == len(s)
    assert len(labelled_sample(d, lab, "toxic", 3, 1, rows=20).collect()) < 40


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(i, 1, 0) for i in range(40)]])
def test_without_both_labels(spark, labels):
    lab = spark.createDataFrame(labels, LABEL)
    d = docs(spark, extra=("score", "x", "v", "y"))
    t = toxicity.ToxicityModel.fit(d, lab).score(d, ["doc_id"]).collect()
    assert len(t) == len(doc_rows()) and {r["__score"] for r in t} == {0.0}
    q = quality.QualityModel.fit(d, lab).score(d).collect()
    assert len(q) == len(doc_rows()) and {r["score"] for r in q} == {1.0}
    kept = toxicity.clean(d, lab)
    assert kept.columns == d.columns and kept.count() == len(doc_rows())


def test_scores_of_odd_texts(spark):
    train = [(i, f"you idiot number {i} are a total idiot" if i % 4 == 0 else f"good plain sentence {i} of the day and night",
              "en", "a", 1) for i in range(1000, 1400)]
    lab = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, *_ in train], LABEL)
    d = docs(spark, doc_rows() + train + [(5000, "YOU 1D10T", "en", "b", 1)], extra=("y", "part", "k0"))
    model = toxicity.ToxicityModel.fit(d, lab)
    assert "idiot" in model.lexicon
    rows = model.score(d, ["doc_id", "text"]).collect()
    assert len(rows) == len(doc_rows()) + 401
    for r in rows:
        assert 0 <= r["__score"] <= 1
        if r["doc_id"] is None or r["doc_id"] < 1000:
            assert r["__score"] < 0.7
        elif r["doc_id"] < 5000:
            assert (r["__score"] >= 0.7) == (r["doc_id"] % 4 == 0)
    assert model.score(empty_docs(spark), ["doc_id"]).collect() == []
    kept = toxicity.clean(d, lab)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {r[0] for r in doc_rows()}


def test_features_are_finite():
    from tests.llm.helpers import LONG
    for t in ("", " ", "a", "!!!", LONG, "İ" * 50, "\u0000", "x" * 100_000, "a|b|c " * 400):
        x = toxicity.features_of(t, {"x": 1.0, "text*": 2.0})
        assert len(x) == len(toxicity.FEATURES) and all(abs(v) < 1e6 for v in x)
        y = quality.features_of(t)
        assert len(y) == len(quality.FEATURES) and all(0 <= v <= 1 for v in y)


@pytest.mark.parametrize("word", ["ПРИВЕТ", "ΚΑΛΗΜΕΡΑ", "ÉCOLE", "SHOUT", "Straße", "quiet"])
def test_capitals_mean_the_same_at_every_length(word):
    at = toxicity.FEATURES.index("capitals")
    want = sum(c.isupper() for c in word) / (len(word) + 1)
    for n in (1, 10, 1000):
        assert toxicity.features_of(f"{word} " * n, {})[at] == pytest.approx(want)


def test_few_rows_of_a_label_are_in_both_parts(spark):
    from quarry.llm.labelled import in_both_parts
    sample = lambda toxic: spark.createDataFrame(
        [(i, f"fine {i}", 0.0, int(i % 10 >= 7)) for i in range(60)] + toxic,
        "doc_id long, text string, y double, part int")
    parts = lambda d: sorted(((r["doc_id"], r["part"]) for r in in_both_parts(d).where("y = 1").collect()))
    for part in (0, 1):
        got = parts(sample([(100 + i, f"bad {i}", 1.0, part) for i in range(6)]))
        assert [i for i, _ in got] == list(range(100, 106)) and sum(p != part for _, p in got) == 1
        assert parts(sample([(100, "bad", 1.0, part)])) == [(100, 0), (100, 1)]
    assert in_both_parts(sample([])) is None
    same = sample([(100, "bad a", 1.0, 0), (101, "bad b", 1.0, 1)])
    assert in_both_parts(same) is same


def test_models_are_fitted_on_few_rows_of_a_label(spark):
    """Toxic rows whose texts all hash to the fitting part."""
    pick = spark.range(400).selectExpr("id", "concat('you idiot number ', id, ' total idiot') t").where(
        "pmod(xxhash64(xxhash64(t), 7), 10) < 7").limit(12).collect()
    rows = [(1000 + i, r["t"], "en", "a", 1) for i, r in enumerate(pick)]
    rows += [(5000 + i, f"good plain sentence {i} of the day and night", "en", "a", 1) for i in range(300)]
    d = docs(spark, rows)
    lab = spark.createDataFrame([(i, int(i >= 5000), int(i < 5000)) for i, *_ in rows], LABEL)
    assert toxicity.ToxicityModel.fit(d, lab).trees is not None
    assert quality.QualityModel.fit(d, lab).constant is None


def test_spaced_letters_count_with_and_without_other_marks():
    at = toxicity.FEATURES.index("spaced")
    for text, want in (("you i d i o t today", 1 / 7), ("you i d i o t to-day", 1 / 7), ("you are kind today", 0.0)):
        assert toxicity.features_of(text, {})[at] == pytest.approx(want)


def test_repeated_word_has_one_rule_at_every_length():
    at = quality.FEATURES.index("top_word")
    for n in (0, 1, 5, 19, 20, 21, 400):
        want = min(1.0, max(0.0, (n - 1) / (n + 10) - 0.1) * 3)
        assert quality.features_of("word " * n)[at] == pytest.approx(want)
        assert quality.features_of(" ".join(f"w{i}" for i in range(n)))[at] == 0.0


def test_sample_bound_holds_for_any_number_of_labels(spark):
    d = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    got = labelled_sample(d, labels, "toxic", 3, 1, rows=500)
    n = got.count()
    assert 400 < n < 600 and got.groupBy("doc_id").count().where("count > 1").count() == 0
    for n, rows in ((10 ** 15, 20_000), (20_001, 20_000)):  # the share of hashes is neither empty nor out of range
        bound = (1 << 64) * rows // n - (1 << 63)
        assert -(1 << 63) < bound < 1 << 63
