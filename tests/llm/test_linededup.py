import collections
import time

from quarry.llm import linededup
from tests.llm.helpers import doc_rows, docs, empty_docs


def brute(rows, ratio, least):
    pages = collections.Counter(h for _, h, _ in rows)
    on = collections.Counter()
    for _, h, t in rows:
        on.update((h, x) for x in set((t or "").split("\n")) if x.strip(" "))
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, h, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        left = [x for x in lines if (h, x) not in bad]
        out.append((i, "\n".join(left), sum(bool(x.strip(" ")) for x in lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, f"h{i % 3}" if i % 7 else "", "\n".join(
        ["menu"] * (i % 2) + [f"line {i % 11}", "", f"own {i}", "  ", "foot" if i % 3 else "f2"] + ["menu"] * (i % 5 == 0)))
        for i in range(120)] + [(500, "h1", None), (501, "h1", ""), (7, "h1", "menu"), (7, "h1", "menu")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    for ratio in (0.1, 0.4):
        got = linededup.drop_boilerplate(df, ratio, 3)
        assert sorted(((r["page_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()),
                      key=str) == brute(rows, ratio, 3)


def test_documents_keep_columns(spark):
    lines = [(i, f"only {i}\ncookie notice\nend {i}", "en", "hot", 1) for i in range(50)]
    d = docs(spark, doc_rows() + lines, extra=("host", "n_lines", "rid", "lines"))
    got = linededup.clean(d)
    assert got.columns == d.columns and got.dtypes == d.dtypes
    rows = got.collect()
    assert len(rows) == len(doc_rows()) + 50
    hot = [r for r in rows if r["source"] == "hot"]
    assert all(r["text"] == f"only {r['doc_id']}\nend {r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in hot)
    assert all(r["host"] == "clash" for r in rows)
    before = sorted(str(r[1]) for r in doc_rows())
    assert sorted(str(r["text"]) for r in rows if r["source"] != "hot") == before


def test_pages_and_empty(spark):
    from pyspark.sql import functions as F
    html = ("<html><head><title>x</title></head><body><script>a<b</script><p>One <b>bold</b>&amp;two</p><!-- no -->"
            "<div>Three<br/>Four</div></body></html>")
    r = spark.createDataFrame([(html, "HTTPS://u:p@Ex.Org:80/a")], "html string, url string").select(
        linededup.visible_text(F.col("html")), linededup.host_of(F.col("url"))).head()
    assert [x for x in r[0].split("\n") if x.strip()] == ["One bold&two", "Three", "Four"] and r[1] == "ex.org"
    assert linededup.clean(empty_docs(spark)).collect() == []


def test_time_follows_the_number_of_lines(spark):
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        rows = [(i, "h", f"{text}\nown {i}") for i in range(4)]
        df = spark.createDataFrame(rows, "page_id long, host string, text string")
        start = time.time()
        got = linededup.drop_boilerplate(df).collect()
        assert [r["text"] for r in sorted(got, key=lambda r: r["page_id"])] == [f"own {i}" for i in range(4)]
        return time.time() - start

    seconds(100)
    few, many = seconds(4_000), seconds(32_000)
    assert many < 20 * few, (few, many)  # 64 times as long where each line meets all removed positions
