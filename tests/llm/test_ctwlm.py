import math

import numpy as np

from quarry.llm import ctwlm
from tests.llm.helpers import crc, doc_rows, docs, empty_docs, words

KT = {}


def log_kt(a, b):
    if (a, b) not in KT:
        x = 0.0
        for i in range(a):
            x += math.log((i + 0.5) / (i + 1))
        for i in range(b):
            x += math.log((i + 0.5) / (a + i + 1))
        KT[(a, b)] = x
    return KT[(a, b)]


def brute_scores(texts, train):
    """The context-tree mixture by its definition, on dictionaries."""
    data = [b" ".join(words(t)) + b"\n" for t in texts]
    depth, nodes = ctwlm.DEPTH, {}
    for x, tr in zip(data, train, strict=True):
        if not tr:
            continue
        x = b"\n" * depth + x
        for i in range(depth, len(x)):
            for k in range(8):
                code, bit = (1 << k) | (x[i] >> (8 - k)), x[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    nodes.setdefault((x[i - d:i], code), [0, 0])[bit] += 1
    children = {}
    for c, code in nodes:
        if c:
            children.setdefault((c[1:], code), []).append((c, code))
    own = {}

    def weigh(node):
        kt = log_kt(*nodes[node])
        if len(node[0]) == depth:
            own[node] = 1.0
            return kt
        below = sum(weigh(c) for c in children.get(node, ()))
        both = math.log(0.5) + np.logaddexp(kt, below)
        own[node] = math.exp(math.log(0.5) + kt - both)
        return both

    for c, code in [n for n in nodes if not n[0]]:
        weigh((c, code))
    out = []
    for x in data:
        x, total = b"\n" * depth + x, 0.0
        for i in range(depth, len(x)):
            for k in range(8):
                code, bit = (1 << k) | (x[i] >> (8 - k)), x[i] >> (7 - k) & 1
                p, rest = 0.0, 1.0
                for d in range(depth + 1):
                    n = nodes.get((x[i - d:i], code), [0, 0])
                    w = own.get((x[i - d:i], code), 0.5) if d < depth else 1.0
                    p += rest * w * (n[bit] + 0.5) / (sum(n) + 1)
                    rest *= 1 - w
                total += math.log10(p)
        out.append(total)
    return out


def brute_base(texts, train):
    c, n = {}, 0
    for t, tr in zip(texts, train, strict=True):
        for w in [*words(t), None] if tr else ():
            c[w] = c.get(w, 0) + 1
            n += 1
    f = n + 0.1 * (len(c) + 1)
    return n, [(len(words(t)) + 1, sum(w in c for w in [*words(t), None]),
                sum(math.log10((c.get(w, 0) + 0.1) / f) for w in [*words(t), None])) for t in texts]


def check(spark, rows, **kw):
    d = docs(spark, rows, extra=("block", "key", "tokens"))
    d = d.withColumn("train", ctwlm.crc_mod("doc_id", 10) != 0)
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                  for r in ctwlm.score_documents(d, **kw).collect()))
    texts, train = [r[1] for r in rows], [crc(r[0], 10) != 0 for r in rows]
    n, base = brute_base(texts, train)
    want = sorted((str(r[0]), *b[:2], n, b[2], s) for r, b, s in zip(
        rows, base, brute_scores(texts, train), strict=True))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9), (g, w)
        assert math.isclose(g[5], w[5], rel_tol=1e-7, abs_tol=1e-7), (g, w)


def test_against_the_definition(spark):
    rows = [r if r[0] != 7 else (7, r[1][:2000], "en", "c", 1) for r in doc_rows()]
    rows += [(i, f"the cat number {i} sat on the mat with cat {i * i}", "en", "a", 1) for i in range(20, 60)]
    check(spark, rows)
    check(spark, rows, block_bytes=300)


def test_without_training_documents(spark):
    held = next(i for i in range(1000) if crc(i, 10) == 0)
    check(spark, [(held, "some words", "en", "a", 1)])
    d = empty_docs(spark).withColumn("train", ctwlm.crc_mod("doc_id", 10) != 0)
    assert ctwlm.score_documents(d).collect() == []


def test_bytes_after_a_context_sum_to_one():
    rnd = np.random.default_rng(4)
    text = bytes(rnd.choice(list(b"abc "), 3000)) + b"\n"
    k, n = np.unique(ctwlm.run_keys([text])[0], return_counts=True)
    ctx = k[len(k) // 2] >> np.uint64(8)
    every = (ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    keys, n = ctwlm.merge_counts([(k, n), (every, np.zeros(256, np.int64))])
    t = ctwlm.Subtrees(keys, n)
    sums = {}
    for code, z, o, w in t.partial():
        for i, c in enumerate(code.tolist()):
            sums[c] = (c, z[i], o[i], w[i])
    p = 10.0 ** t.log_p(ctwlm.top_levels(list(sums.values())))
    assert abs(p[np.isin(keys, every)].sum() - 1) < 1e-9


def test_learns_more_than_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn(
        "train", ctwlm.crc_mod("doc_id", 10) != 0)
    r = ctwlm.score_documents(d).where("not train").selectExpr("sum(score) s", "sum(base_score) b").head()
    assert r["s"] > r["b"]
