import hashlib
import heapq
import itertools
import random
import re
import zlib

from quarry.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
WS = "[\\x20\\x09-\\x0d]"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        if code in (1, 2):
            text = "" if code == 1 else re.sub("[.!?]", "", text)
        out += [(c, t, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(items):
    """Least (cost, audit, lines) over all edit sequences, by a search that carries whole audits."""
    want, to = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
    keep = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(items) and state in (0, 3):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        push = [(cost + 3, audit + "I", i, to[state], (*lines, f"{want[state]}:"))]
        if i < len(items):
            role, text, fault = items[i]
            push.append((cost + 4, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                push.append((more + 3, audit + "R", i + 1, to[state], (*lines, f"{want[state]}:{text}")))
                if role[:1] in keep[state]:
                    push.append((more, audit + "K", i + 1, keep[state][role[:1]], (*lines, f"{role}:{text}")))
        for p in push:
            heapq.heappush(heap, p)


def brute(rows):
    out = {}
    hurt = damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        items, seen = [], set()
        for _, _, role, text in own:
            last = re.sub(f"{WS}+\\Z", "", text)[-1:]
            fault = ("blank" if not last else "duplicate" if (role, text) in seen
                     else "truncated" if last not in ".!?" else "none")
            seen.add((role, text))
            items.append((role, text, fault))
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = cheapest(items)
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(items)]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                  *(sum(i[2] == f for i in items) for f in ("blank", "duplicate", "truncated")),
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answers(df):
    names = [*cv.COUNTS, "cost", "audit", "repaired_sha256"]
    rows = cv.repair_structure(cv.damaged(df)).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def random_rows(seed, n):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "What?", "", "  \n", "Fine!\t", "and so", "Yes.\x0b", "x. y", "é…", None]
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            turn = None if rnd.random() < 0.05 else t + (rnd.random() < 0.1)
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "u", None])
            out.append((None if c == 3 else c, turn, role, rnd.choice(texts)))
    return out + out[:7]


def test_against_a_search_over_whole_audits(spark):
    rows = random_rows(4, 250)
    assert answers(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    assert answers(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_dropped_and_clashing_columns(spark):
    assert answers(spark.createDataFrame([], SCHEMA)) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 1, "user", "Hi.", "z", 1, "z", "z")],
                               SCHEMA + ", sig string, pos int, code string, gone string")
    assert answers(df) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversation_and_text(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i}." if i % 5 else "cut") for i in range(1500)]
    rows.append((2, 0, "user", "word " * 200_000))
    assert answers(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nodes_are_shared_suffixes():
    """Each distinct suffix is one node, made once, when signatures come sorted by their reversed text."""
    rnd = random.Random(2)
    sigs = {"".join(rnd.choice("suaxSUAXd") for _ in range(rnd.randint(0, 6))) for _ in range(3000)}
    automaton = cv.SuffixAutomaton()
    fault = {"d": "blank"}
    for r in sorted(s[::-1] for s in sigs):
        automaton.turn_to(r.encode())
        items = [(c.lower(), "t", fault.get(c, "truncated" if c.isupper() else "none")) for c in r[::-1]]
        assert automaton.best() == cheapest(items)[:2]
    assert automaton.made == len({s[i:] for s in sigs for i in range(len(s))})


def test_hot_signature_is_solved_once(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "Same.") for c in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    per = cv.profiles(cv.ordered(cv.damaged(df)).repartition("conv_id"))
    assert cv.solved(per.select("sig").distinct()).count() == per.select("sig").distinct().count() < 60
    assert answers(df) == brute(rows)
