import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import collocations as co
from tests.llm.helpers import LONG, doc_rows, docs, empty_docs


def brute(rows, least, top, inside=80):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    drop = set()
    for p, a in cand.items():
        w = p[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                s = (p[0], *w[i:i + k])
                if 100 * a >= inside * f[s]:
                    drop.add(s)
    by = defaultdict(list)
    for p, a in cand.items():
        if p not in drop:
            lang, w = p[0], p[1:]
            cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s)
                  for lang, x in by.items() for i, (s, a, p, left, r) in enumerate(sorted(x)[:top]))


def text_rows(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["New", "York", "City", "naïve", "漢字", "\x00", "a-b", "x_y", "\x1c"]
    out = []
    for i in range(n):
        t = []
        for _ in range(rnd.randint(0, 60)):
            t.append(rnd.choice(words) if rnd.random() < 0.6 else rnd.choice(["new york city", "of the\t end", "W1 w2 w3 W4 w5"]))
            t.append(rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "]))
        out.append((i, "".join(t), rnd.choice(["en", "de", None, "und", ""]), "s", 1))
    return out


def answers(df, **how):
    return sorted(tuple(r) for r in co.collocations(df, **how).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("size", [(900, 300), (1 << 20, 1 << 20)])
def test_against_counting_everything(spark, size, monkeypatch):
    monkeypatch.setattr(co, "ROWS", 500)
    rows = text_rows(1, 300)
    assert answers(docs(spark, rows), least=6, top=50, size=size[0], piece=size[1]) == brute(rows, 6, 50)


def test_nulls_long_texts_repeats_and_clashes(spark):
    rows = doc_rows() + doc_rows()[:4] * 3
    extra = ("words", "counts", "shard", "id", "w1", "f", "rank", "phrase")
    assert answers(docs(spark, rows, extra), least=5, top=2000) == brute(rows, 5, 2000)
    assert len(LONG) > 100_000


def test_empty(spark):
    assert answers(empty_docs(spark)) == []
    assert answers(docs(spark, [(1, None, "en", "a", 0), (2, " \n.", None, "a", 0)])) == []


def naive(t, k):
    return Counter(tuple(t[i:i + k]) for i in range(len(t) - k + 1) if 0 not in t[i:i + k])


@pytest.mark.parametrize("sigma", [5, 70_000])
def test_index_counts_every_phrase(sigma, monkeypatch):
    monkeypatch.setattr(co, "ROWS", 700)
    rnd = np.random.default_rng(4)
    t = np.r_[0, np.where(rnd.random(4000) < 0.1, 0, rnd.integers(max(1, sigma - 4), sigma + 1, 4000)), 0].astype(
        np.uint16 if sigma < 1 << 16 else np.uint32)
    p = co.Phrases(co.transform(t), co.transform(t[::-1]), sigma)
    a, b, n = (np.concatenate(x) for x in zip(*p.pairs(), strict=True))
    plain = t.tolist()
    assert {(int(x), int(y)): int(c) for x, y, c in zip(a, b, n, strict=True)} == naive(plain, 2)
    *w, n = p.longer(np.sort(a * (sigma + 1) + b))
    got = {tuple(int(x) for x in r[:4] if x): int(r[4]) for r in zip(*w, n, strict=True)}
    assert got == naive(plain, 3) | naive(plain, 4)


def test_longer_phrases_need_frequent_pairs():
    t = np.array([0, 1, 2, 3, 0, 1, 2, 4, 0, 2, 3, 0], np.uint16)
    p = co.Phrases(co.transform(t), co.transform(t[::-1]), 4)
    *w, n = p.longer(np.array([1 * 5 + 2, 2 * 5 + 3]))
    assert [tuple(int(x) for x in r) for r in zip(*w, n, strict=True)] == [(1, 2, 3, 0, 1)]
    assert len(p.longer(np.zeros(0, np.int64))[0]) == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = spark.createDataFrame([(9 * 10**18, 9 * 10**18 + 1, 9 * 10**18 + 5)], "f long, l long, r long")
    score = big.select(F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) DIV "
                              "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")).head()[0]
    assert score == 2000000 * 9 * 10**18 // (18 * 10**18 + 6)


def test_shards_send_packets_and_no_row_a_phrase(spark, monkeypatch):
    sent = {}
    for name in ("pair_counts", "longer_counts"):
        def kept(*a, made=getattr(co, name), name=name):
            sent[name] = made(*a)
            return sent[name]
        monkeypatch.setattr(co, name, kept)
    _, _, phrases = co.phrase_counts(docs(spark, text_rows(3, 300)), least=2, piece=300)
    assert phrases.count() > 1000
    assert sent["pair_counts"].count() <= 4  # a shard and a bucket for each of four languages
    assert sent["longer_counts"].count() <= 16


def test_packets_hold_every_row_once():
    rnd = np.random.default_rng(5)
    ids = np.r_[0, np.sort(rnd.integers(1, 1 << 62, 99))]
    cols, n = [rnd.integers(0, 100, 1000) for _ in range(2)], rnd.integers(1, 1 << 40, 1000)
    sent = co.packets(3, 70, 7, ids, cols, n).to_pylist()
    assert [r["bucket"] for r in sent] == list(range(70, 77)) and {r["shard"] for r in sent} == {3}
    got = np.concatenate([co.unpacked_rows(r["data"], 3, r["n"]) for r in sent], axis=1)
    assert sorted(zip(*got.tolist(), strict=True)) == sorted(zip(*(ids[x].tolist() for x in cols), n.tolist(), strict=True))
    for bucket, at in co.dealt(ids, cols, 7):
        assert (np.diff(at) > 0).all() and sent[bucket]["n"] == len(at)
    assert co.packets(0, 0, 5, ids, [x[:0] for x in cols], n[:0]).num_rows == 0
