import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def good(e):
    return bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)


def brute(rows, k=20):
    """Each query row's k best others, every pair computed."""
    rows = [(i, np.array(e, np.float32).astype(float)) for i, e in rows if good(e)]
    width = max((len(e) for _, e in rows), default=0)
    x = np.array([np.pad(e, (0, width - len(e))) for _, e in rows])
    out = []
    for n, (i, _) in enumerate(rows):
        if i is None or i % 20:
            continue
        s = np.cumsum(x * x[n], axis=1)[:, -1]
        best = sorted((0.0 - s[m], ann.NO_ID if rows[m][0] is None else rows[m][0]) for m in range(len(rows)) if m != n)[:k]
        out += [(i, r + 1, None if b[1] == ann.NO_ID else b[1], 0.0 - b[0]) for r, b in enumerate(best)]
    return out


def answers(spark, rows, schema=SCHEMA, k=20):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], schema)
    out = ann.search(df, df.where(F.col("vec_id") % 20 == 0), k)
    return [tuple(r) for r in out.collect()]


def test_small_tables_are_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(size=12) * (1 + i % 5))]) for i in range(90)]
    rows += [(200 + i, rows[40][1]) for i in range(60)]  # copies of a query, queries among them
    rows += [(None, rows[3][1]), (40, rows[7][1]), (40, rows[40][1]), (300, rows[5][1][:7])]
    bad = [None, [], [0.0] * 12, [float("nan")] * 12, [1.0, None], [float("inf")] + [1.0] * 11]
    rows += [(400 + 20 * i, e) for i, e in enumerate(bad)]

    def order(r):
        return (r[0], r[1], ann.NO_ID if r[2] is None else r[2])
    want, have = sorted(brute(rows), key=order), sorted(answers(spark, rows), key=order)
    assert len(have) == len(want)
    # rows of one id are queries of their own; which is which does not show
    assert np.allclose([r[3] for r in have], [r[3] for r in want], rtol=1e-12)
    assert sum(a[:3] == b[:3] for a, b in zip(have, want, strict=True)) >= 0.97 * len(want)


def test_few_candidates_and_empty_tables(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(20, [1.0, 2.0])]) == []
    assert answers(spark, [(1, [1.0, 2.0]), (3, [2.0, 0.0])]) == []
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-3.0, 1.0]), (3, [0.5, -1.0])]
    assert sorted(answers(spark, rows)) == [(0, 1, 1, 0.5), (0, 2, 3, 0.5), (0, 3, 2, -3.0)]
    assert sorted(answers(spark, rows, k=1)) == [(0, 1, 1, 0.5)]


def test_other_columns_do_not_matter(spark):
    names = SCHEMA + ", v string, ids string, l string, cell string, hits string"
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, "a", "b", "c", "d", "e") for i in range(41)], names)
    out = ann.search(df, df.where("vec_id % 20 = 0"), 2)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out.collect()) == [
        (0, 1, 1), (0, 2, 2), (20, 1, 40), (20, 2, 39), (40, 1, 39), (40, 2, 38)]


@pytest.mark.parametrize("kind", ["directions", "groups", "lengths"])
def test_recall(spark, kind):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4000, 32))
    if kind == "groups":
        x = x[rnd.integers(0, 60, 4000)] + 0.4 * x
    if kind == "lengths":
        x *= rnd.lognormal(sigma=1.0, size=(4000, 1))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    want, have = brute(rows), answers(spark, rows)
    assert len(have) == len(want)
    assert len({r[:1] + r[2:3] for r in have} & {r[:1] + r[2:3] for r in want}) >= 0.93 * len(want)
    exact = {(r[0], r[2]): r[3] for r in want}
    assert all(exact.get((r[0], r[2]), r[3]) == r[3] for r in have)


def test_scan_abandons_early_and_keeps_the_near():
    rnd = np.random.default_rng(5)
    ix = ann.Index(64, np.eye(64)[:1])
    x = rnd.normal(size=(500, 64))
    q = x[:40] + 0.5 * rnd.normal(size=(40, 64))
    s = q @ x.T
    bound = np.sort(s, axis=1)[:, -1]
    r = ix.rotated(x)
    blocks = [r[:, i:i + 16] for i in range(0, 64, 16)]
    alive, made = ann.scan(ix.rotated(q), blocks, np.ones(s.shape, bool), (x * x).sum(axis=1), bound)
    assert (alive.sum(axis=1) <= 1).all() and alive.sum() >= 39
    assert made < 0.6 * s.size * 64


def test_cells_have_room():
    first, parts = ann.deal(np.array([10, 500, 30, 2000, 5, 0, 600]), 512)
    assert parts.tolist() == [1, 1, 1, 4, 1, 1, 2]
    assert first.tolist() == [0, 0, 1, 2, 6, 6, 7]


def test_first_bound_is_never_above_the_true_one():
    rnd = np.random.default_rng(7)
    ix = ann.Index(8, np.eye(8)[:1])
    x, q = rnd.normal(size=(300, 8)), rnd.normal(size=(20, 8))
    ix.seeds = x[:100]
    assert (ix.first_bound(q, 21) <= np.sort(q @ x.T, axis=1)[:, -21]).all()


def test_queries_in_their_cells_are_not_broadcast(spark, tmp_path):
    ix = ann.Index(4, np.eye(4))
    share = spark.sparkContext.broadcast(ix)
    cells = [(c, np.eye(4)[c:c + 1].tobytes()) for c in range(4)]
    spark.createDataFrame(cells, "cell long, x binary").write.parquet(str(tmp_path / "cells"))
    spark.createDataFrame([(np.ones(4).tobytes(),)], "v binary").write.parquet(str(tmp_path / "asks"))
    one = F.lit(np.zeros(1, np.int64).tobytes())
    kept = spark.read.parquet(str(tmp_path / "cells")).select(
        "cell", "x", one.alias("l"), F.lit(np.ones(1, np.int64).tobytes()).alias("n_ids"), one.alias("ids"),
        F.array("x").alias("blocks"))
    blocks = ann.probed(spark.read.parquet(str(tmp_path / "asks")), share, 4, 1)
    assert blocks.count() >= 1
    plan = ann.search_cells(kept, blocks, share, 4, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
