import re

from pyspark.sql import functions as F

from quarry.llm import decontaminate as dc
from tests.llm.helpers import BENCH, LONG, doc_rows, docs, empty_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOX = "quick brown fox jumps over the lazy dog and runs away"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, n=10):
    w = WORD.findall(lower(text))
    hit, ids = set(), set()
    for i, t in items:
        x = WORD.findall(lower(t))
        m = min(n, len(x))
        for a in range(len(x) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p:p + m] == x[a:a + m]:
                    hit.update(range(p, p + m))
                    ids.add("" if i is None else str(i))
    return len(w), len(hit), sorted(ids)


ITEMS = [(7, FOX), (12, "over the LAZY-dog, and runs away from the big bad wolf"), (3, "one two"), (4, None), (5, ""),
         (None, "straße 漢字"), (7, "null id"), (8, "..."), (100, "word7 text7 word8 text8 word9 text9 word10")]


def items(spark):
    return spark.createDataFrame(ITEMS, BENCH)


def test_against_brute_force(spark):
    rows = doc_rows()
    rows[7] = (7, LONG[:4000], "en", "c", 1)
    got = dc.contaminated(docs(spark, rows, extra=("n_hit", "hit")), items(spark)).collect()
    want = sorted((str(r[0]), *brute(r[1], ITEMS)) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_spans_are_offsets_of_the_original(spark):
    text = "Ünï\x00cödé 😀 -- The Quick, brown\tFOX jumps over the lazy dog and runs away... end"
    d = docs(spark, [(1, text, "en", "a", 1)])
    r = dc.contaminated(d, items(spark)).head()
    assert [text[s["start"]:s["end"]] for s in r["spans"]] == ["Quick, brown\tFOX jumps over the lazy dog and runs away"]


def test_blocks_of_items_give_the_same_result(spark):
    a = dc.contaminated(docs(spark), items(spark)).collect()
    b = dc.contaminated(docs(spark), items(spark), block_words=12).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_clean_keeps_columns_and_clean_documents(spark):
    d = docs(spark, extra=("__hit", "n_words"))
    kept = dc.clean(d, spark.createDataFrame([(1, FOX)], BENCH))
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["3", "4", "5", "6", "7", "10", "None", "None"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCH)
    assert dc.contaminated(empty_docs(spark), items(spark)).collect() == []
    assert dc.contaminated(docs(spark), none).where(F.col("contaminated")).count() == 0
    assert dc.contaminated(docs(spark), spark.createDataFrame([(1, "")], BENCH)).where("n_hit > 0").count() == 0


def test_blocks_are_bounded_and_fetched_one_by_one(spark, monkeypatch):
    """Many blocks: within the bound, all items once, none on the driver before its own pass."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i % 5))) for i in range(120)] + [(5, "w5x0 w5x1"), (5, "w5x0 w5x1")]
    d = spark.createDataFrame(rows, BENCH)
    blocks = dc.item_blocks(d, 60)
    assert len(blocks) > 5 and not any(isinstance(b, list) for b in blocks)
    got = [[(r["item_id"], r["text"]) for r in b.collect()] for b in blocks]
    assert all(sum(len(t.split()) for _, t in b) <= 60 for b in got)
    assert sorted(x for b in got for x in b) == sorted({(str(i), t) for i, t in rows})
    live = []
    cast = type(spark.sparkContext).broadcast

    def note(self, value):
        b = cast(self, value)
        live.append(b)
        assert len(live) - len(gone) == 1
        return b

    gone = []
    kind = type(spark.sparkContext.broadcast({}))
    end = kind.destroy
    monkeypatch.setattr(kind, "destroy", lambda self, blocking=False: (gone.append(self), end(self, blocking))[1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", note)
    texts = [(1, rows[17][1], "en", "a", 1), (2, f"x {rows[88][1]} y", "en", "a", 1), (3, "clean", "en", "a", 1)]
    out = dc.contaminated(docs(spark, texts), d, block_words=300).collect()
    assert {r["doc_id"]: r["item_ids"] for r in out} == {1: ["17"], 2: ["88"], 3: []}
    assert len(live) > 1 and len(gone) == len(live) - 1
