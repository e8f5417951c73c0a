import collections
import random

import pytest

from quarry.llm import jaccard
from tests.llm.helpers import doc_rows, docs, empty_docs, words


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    by = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, (_, s) in enumerate(sets):
        for j, both in collections.Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_chains_copies_and_shared_passages(spark):
    rnd = random.Random(5)
    text = lambda n: [f"t{rnd.randrange(300)}" for _ in range(n)]
    rows, passage = [], text(60)
    for f in range(12):
        base = text(rnd.choice([3, 8, 40, 120]))
        for _ in range(rnd.choice([1, 4, 25])):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            if rnd.random() < 0.3:
                w += text(rnd.randrange(8))
            rows.append(w)
    chain = text(100)
    for i in range(30):
        chain = chain[2:] + text(2)
        rows.append(list(chain))
    rows += [text(20) + passage + text(20) for _ in range(60)]
    rows = [(1000 - i, " ".join(w), "en", "a", 0) for i, w in enumerate(rows)]
    assert got(jaccard.jaccard_components(docs(spark, rows))) == brute(rows)
    assert got(jaccard.jaccard_components(docs(spark, rows), cells=1 << 6)) == brute(rows)


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert got(jaccard.jaccard_components(d)) == brute(rows)


def test_edges_and_one_of_each(spark):
    rows = doc_rows()
    d = docs(spark, rows, extra=("sid", "n", "keys", "l_id"))
    out = jaccard.jaccard_components(d).collect()
    named = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None)
    assert named == brute([r for r in rows if r[0] is not None])
    assert len(out) == len(rows)
    assert all(r["component_id"] is None for r in out if r["doc_id"] is None)
    kept = jaccard.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        ["1", "3", "4", "5", "6", "7", "10", "None", "None"])
    assert jaccard.jaccard_components(empty_docs(spark)).collect() == []
    assert jaccard.one_of_each(empty_docs(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 100, 1001])
def test_prefix_lengths(n):
    assert jaccard.probe_length(n) == n - (4 * n + 4) // 5 + 1


def test_overlap_bound_is_never_below_the_overlap():
    import numpy as np
    rnd = np.random.default_rng(2)
    for n in (3, 40, 700, 3000):
        a = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rnd.integers(0, 2 ** 63, max(1, n // 3)).astype(np.uint64)]))
        ca, cb = jaccard.columns_of(a), jaccard.columns_of(b)
        real = len(np.intersect1d(a, b))
        assert real <= jaccard.overlap_bound(ca, cb, len(a)) <= len(a)
        assert real <= jaccard.overlap_bound(ca, jaccard.union_columns([cb, ca]), len(a))
