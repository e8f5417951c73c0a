import random

import pytest

from quarry.llm import licenses
from tests.llm.helpers import doc_rows, docs, empty_docs

GPL = licenses.TEMPLATES[5][1]


def test_exact_and_near_notices_are_found(spark):
    rnd = random.Random(3)
    filler = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{filler(rnd.randrange(60))} {text.upper() if i % 2 else text}\n{filler(40)}", "en", "a", 0))
        want[i] = name
    words = GPL.split()
    words[20] = "CHANGED"
    rows.append((100, f"{filler(30)} {' '.join(words)} {filler(10)}", "en", "a", 0))
    want[100] = "gpl-3.0"
    rows.append((200, f"{filler(10)} {' '.join(GPL.split()[:15])} {filler(20)}", "en", "a", 0))
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(docs(spark, rows, extra=("matches",))).collect()}
    for i, name in want.items():
        assert name in {m["license"] for m in got[i]}, i
    assert got[200] == []
    m = [m for m in got[1] if m["license"] == "apache-2.0"][-1]
    assert rows[1][1][m["start"]:m["end"]].lower().startswith("licensed under the apache")


def test_against_exact_scan(spark):
    """Every place that holds a whole template is reported with containment 1."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: {m["license"] for m in r["matches"] if m["containment"] == 1.0}
           for r in licenses.scan(d).collect()}
    for r in d.select("doc_id", "text").collect():
        w = b" " + b" ".join(licenses.words_of(r["text"].encode())) + b" "
        want = {n for n, t in licenses.TEMPLATES if b" " + b" ".join(licenses.words_of(t.encode())) + b" " in w}
        assert got[r["doc_id"]] == want


def test_edges(spark):
    got = licenses.scan(docs(spark)).collect()
    assert len(got) == len(doc_rows()) and all(r["matches"] == [] for r in got)
    assert licenses.scan(empty_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        licenses.Templates([("x", "...")])


def test_edited_notices_at_every_offset():
    """Words changed or inserted, down to the bound: found wherever the notice starts."""
    mit = licenses.TEMPLATES[3][1].split()
    built = licenses.Templates(licenses.TEMPLATES)

    def found(before, notice, after=40):
        words = [f"p{i}" for i in range(before)] + notice + [f"q{i}" for i in range(after)]
        return [m for m in built.matches(licenses.words_of(" ".join(words).encode())) if m[0] == "mit"]

    n = len(licenses.words_of(" ".join(mit).encode()))
    for start in range(12):
        for k in range(5, len(mit) - 5):
            m = found(start, mit[:k] + ["changed"] + mit[k + 1:])
            assert [(a, z, round(c, 2)) for _, a, z, c in m] == [(start, start + n - 1, 0.8)], (start, k)
            m = found(start, mit[:k] + ["put", "in", "here"] + mit[k:])
            assert [(a, z, round(c, 2)) for _, a, z, c in m] == [(start, start + n + 2, 0.84)], (start, k)
        assert found(start, mit[:8] + ["x"] + mit[9:20] + ["y"] + mit[21:]) == []


def test_neighbouring_and_long_notices():
    mit = licenses.TEMPLATES[3][1].split()
    n = len(mit)
    built = licenses.Templates(licenses.TEMPLATES)
    head, tail = mit[:6] + ["x"] + mit[7:], mit[:20] + ["y"] + mit[21:]
    words = licenses.words_of(" ".join(head + tail + mit + mit).encode())
    assert [(a, z) for name, a, z, _ in built.matches(words) if name == "mit"] == [
        (k * n, k * n + n - 1) for k in range(4)]
    rnd = random.Random(8)
    long = [f"t{rnd.randrange(3000)}" for _ in range(1500)]
    built = licenses.Templates([("long", " ".join(long))])
    for start in (0, 1, 95, 187):
        edited = [f"e{i}" if i % 25 == 24 else w for i, w in enumerate(long)]
        words = [b"p"] * start + [w.encode() for w in edited] + [b"q"] * 300
        m = built.matches(words)
        assert len(m) == 1 and m[0][3] >= 0.8 and abs(m[0][1] - start) < 25
