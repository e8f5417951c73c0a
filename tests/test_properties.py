"""Property test: the distributed comparison kernel equals a brute-force definition."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.operators import compare as CMP

ROW = st.tuples(st.sampled_from(["gen", "gold"]), st.integers(1, 3),
                st.one_of(st.none(), st.integers(0, 2)), st.sampled_from([0.0, 1.0]))


def _brute(rows, q):
    gen = [(a, b) for s, qq, a, b in rows if qq == q and s == "gen"]
    gold = [(a, b) for s, qq, a, b in rows if qq == q and s == "gold"]

    def sset(rs):
        return {tuple(sorted(str(v) for v in r)) for r in rs}

    d1 = True if not gen and not gold else (False if not gen or not gold else sset(gen) == sset(gold))
    d2 = True if not gen and not gold else (False if not gen or not gold else sorted(gen, key=repr) == sorted(gold, key=repr))
    g, o = set(gen), set(gold)
    jac = len(g & o) / len(g | o) if g and o else (1.0 if g == o else 0.0)
    if gen and gold:
        p, r = len(g & o) / len(g), len(g & o) / len(o)
        f1 = 2 * p * r / (p + r) if p + r > 0 else 0.0
    else:
        p = r = f1 = 1.0 if not gen and not gold else 0.0
    return d1, d2, round(jac, 6), round(p, 6), round(r, 6), round(f1, 6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=12))
def test_kernel_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "side string, question long, a long, b double")
    qs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "q long")
    d1 = {r[0]: r[1] for r in CMP.exact_set_match(df, ["a", "b"], qs).collect()}
    d2 = {r[0]: r[1] for r in CMP.multiset_match(df, ["a", "b"], qs).collect()}
    d3 = {r["question"]: r["jaccard"] for r in CMP.jaccard_match(df, ["a", "b"], qs).collect()}
    d4 = {r["question"]: (r["precision"], r["recall"], r["f1"]) for r in CMP.overlap_prf(df, ["a", "b"], qs).collect()}
    for q in (1, 2, 3):
        e1, e2, ej, ep, er, ef = _brute(rows, q)
        assert (d1[q], d2[q], d3[q], d4[q]) == (e1, e2, ej, (ep, er, ef)), (q, rows)
