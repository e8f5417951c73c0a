"""Operator 12: repair of conversation structure with a suffix-shared automaton.

A conversation's rows become a signature of one symbol a row (role and fault).
The cheapest edits that make the roles a word of ``(s?(ua)+)?`` depend on the
signature alone, and the cost-to-go at a row depends on the rest of the
signature alone.  So the distinct signatures of all conversations are sorted by
their reversed text, which makes equal endings neighbours, and an automaton
that shares suffixes is built from the end: a node is one distinct suffix and
leads to the node of the suffix without its first symbol.  Each node gets, once
for every grammar state, its cost-to-go and the first edit of its best audit;
the rest of that audit is read at the nodes it leads to.  As the input is
sorted, a node whose suffix does not end the next signature will never be met
again, so only the nodes of one signature are kept.  Tasks take ranges of
reversed signatures; only the nodes on the edge of a range are made twice.

Grammar states: 0 nothing yet, 1 after ``s``, 2 after ``u``, 3 after ``a``.
Edits: Delete, Insert, Keep, Rerole.  In one state every kind of edit leads to
one state only, so the least audit is the one that begins with the least edit.

Defined results: nulls read as one space, also in the text that is hashed for
damage; a null id is a conversation like any other; null turns come first; rows
of one turn come by role, then text; repeated rows are rows.  A role other than
s.., u.., a.. (an empty one too) can only be rerolled or deleted.  A
conversation without rows after damage has zeros, an empty audit and the digest
of the empty text.  An empty table gives no rows.  Other columns, whatever their
names, are not read.

Scale: conversations are dealt by id, their rows stream through a task in order
and are never gathered: a task holds the signature of one conversation (a byte
a row) and hashes texts as they pass.  The digest and the audit are single
values of a conversation, so the rows of one conversation meet in one task,
sorted on disk; that is the limit for a conversation that holds a large part of
all rows.  A signature shared by many conversations is solved once.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

SPACES = "\t\n\x0b\x0c\r "
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("none", "blank", "duplicate", "truncated")
# Symbol of role s, u, a, other by fault; a row that must go is d whatever its role.
SYMBOLS = b"suax" + b"dddd" + b"dddd" + b"SUAX"
WANTED = ("user", "user", "assistant", "user")  # the role that a state asks for
MOVES = (2, 2, 3, 2)                            # the state it leads to
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINISH = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): every row after the damage that its hash selects; dropped rows are marked."""
    code = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), code.alias("code"),
                             _or_space("role").alias("role"), _or_space("text").alias("text"))
    text = (F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(copies).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) -> with pos from 1 and code (role + 4 * fault), dealt by conversation."""
    own = Window.partitionBy("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(
        F.col("turn").asc_nulls_first(), "copy"))
    order = (F.col("turn").asc_nulls_first(), "role", "text", "copy")
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    role = F.substring("role", 1, 1)
    role = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    fault = (F.when(last == "", 1).when(F.col("seen") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0))
    return (rows.repartition("conv_id").withColumn("seen", seen)
            .withColumn("pos", F.row_number().over(own.orderBy(*order)))
            .select("conv_id", "turn", "role", "text", "gone", "pos", (role + 4 * fault).cast("int").alias("code")))


def profiles(rows: DataFrame) -> DataFrame:
    """Ordered rows -> conv_id, sig and the counts, one row a conversation, rows streamed in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "sig", *COUNTS]

    def run(batches):
        legal = np.zeros((4, 4), bool)
        legal[0, 1] = legal[1, 2] = legal[2, 1] = True
        symbol = np.frombuffer(SYMBOLS, np.uint8)
        now, done = None, []  # the conversation being read, results of those before

        def result(c):
            turns = c["high"] - c["low"] + 1 - c["turns"] if c["turns"] else 0
            return (c["id"], c["sig"].decode(), turns, *(int(x) for x in c["n"]))

        for b in batches:
            code, gone = (b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "gone"))
            first = b.column("pos").to_numpy(zero_copy_only=False) == 1
            start, turn = np.flatnonzero(first), b.column("turn")
            for lo, hi in zip(np.r_[0, start], np.r_[start, b.num_rows]):
                if lo == hi:
                    continue
                if first[lo]:
                    if now:
                        done.append(result(now))
                    now = {"id": b.column("conv_id")[lo].as_py(), "sig": bytearray(), "n": np.zeros(4, np.int64), "role": None,
                           "turns": 0, "low": None, "high": None}
                at = np.arange(lo, hi)[~gone[lo:hi]]
                if not len(at):
                    continue
                c = code[at]
                now["sig"] += symbol[c].tobytes()
                now["n"][:3] += np.bincount(c // 4, minlength=4)[1:4]
                roles = c % 4 if now["role"] is None else np.r_[now["role"], c % 4]
                now["n"][3] += (~legal[roles[:-1], roles[1:]]).sum()
                now["role"] = roles[-1]
                t = turn.take(pa.array(at)).drop_null().to_numpy(zero_copy_only=False)
                if len(t):
                    known = t if now["high"] is None else np.r_[now["high"], t]
                    now["turns"] += int((known[1:] != known[:-1]).sum()) + (now["high"] is None)
                    now["low"] = int(t[0]) if now["low"] is None else now["low"]
                    now["high"] = int(t[-1])
            yield from rows_out(done, names, b.column("conv_id").type, 2)
            done, kind_of_id = [], b.column("conv_id").type
        if now:
            yield from rows_out([result(now)], names, kind_of_id, 2)

    return rows.select("conv_id", "turn", "gone", "pos", "code").sortWithinPartitions("conv_id", "pos").mapInArrow(
        run, f"conv_id {kind}, sig string, " + ", ".join(f"{c} long" for c in COUNTS))


def rows_out(rows: list[tuple], names: list[str], id_type, texts: int):
    """The rows as one batch; texts: the place of the first number."""
    if rows:
        columns = list(zip(*rows, strict=True))
        kinds = [id_type, *([pa.string()] * (texts - 1)), *([pa.int64()] * (len(names) - texts))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class SuffixAutomaton:
    """Nodes of the suffixes of one signature: cost-to-go and first edit for each grammar state.

    ``turn_to`` moves on to the next signature and makes only the nodes of
    suffixes that the last one did not end with.
    """

    def __init__(self):
        self.word = b""                                  # the last signature, reversed
        self.cost = array("q", [c for c, _ in FINISH])   # four of each node, the empty suffix first
        self.edit = bytearray(4)                         # the empty suffix ends by FINISH
        self.made = 0

    def turn_to(self, reversed_signature: bytes) -> None:
        same = common(self.word, reversed_signature)
        del self.cost[4 * (same + 1):], self.edit[4 * (same + 1):]
        for symbol in reversed_signature[same:]:
            self._node(chr(symbol))
        self.word = reversed_signature

    def _node(self, symbol: str) -> None:
        """The node of ``symbol`` before the suffix of the last node."""
        rest = self.cost[-4:]
        role, extra = symbol.lower(), 0 if symbol.islower() else TRUNCATED
        found = []
        for state in range(4):
            options = [(DELETE + rest[state], "D")]
            if symbol != "d":
                options.append((REROLE + extra + rest[MOVES[state]], "R"))
                if role in KEPT[state]:
                    options.append((extra + rest[KEPT[state][role]], "K"))
            found.append(options)
        least = [min(x)[0] for x in found]
        # one inserted row at most before a row is used: two lead back to a state that costs less
        after = [min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])]
        for state in range(4):
            options = [*found[state], (INSERT + after[MOVES[state] - 2], "I")]
            cost = min(options)[0]
            self.cost.append(cost)
            self.edit.append(ord(min(e for c, e in options if c == cost)))
        self.made += 1

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature."""
        at, state, audit = len(self.word), 0, bytearray()
        while at:
            edit = self.edit[4 * at + state]
            audit.append(edit)
            role = chr(self.word[at - 1]).lower()
            state = after_edit(chr(edit), state, role)
            at -= edit != ord("I")
        return self.cost[4 * len(self.word)], audit.decode() + FINISH[state][1]


def after_edit(edit: str, state: int, role: str) -> int:
    if edit == "D":
        return state
    return KEPT[state][role] if edit == "K" else MOVES[state]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def solved(signatures: DataFrame) -> DataFrame:
    """Distinct signatures (sig) -> sig, cost, audit; endings shared within each range of reversed signatures."""

    def run(batches):
        automaton = SuffixAutomaton()
        for b in batches:
            sigs, out = b.column("sig"), []
            for r in b.column("rev").to_pylist():
                automaton.turn_to(r.encode())
                out.append(automaton.best())
            yield pa.RecordBatch.from_arrays([sigs, pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())],
                                             names=["sig", "cost", "audit"])

    rev = signatures.select("sig", F.reverse("sig").alias("rev"))
    return rev.repartitionByRange("rev").sortWithinPartitions("rev").mapInArrow(run, "sig string, cost long, audit string")


class Repair:
    """Applies an audit to the rows of a conversation in order and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.digest, self.empty = hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        if not self.empty:
            self.digest.update(b"\n")
        self.empty = False
        self.digest.update(f"{role}:{text}".encode())

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(WANTED[self.state], "")
            self.state, self.at = MOVES[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text)
        elif edit == "R":
            self.line(WANTED[self.state], text)
        self.state = after_edit(edit, self.state, role[:1])

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Ordered rows and (conv_id, counts, cost, audit) -> one row a conversation with the digest of its repaired text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    longs = [*COUNTS, "cost"]
    heads = audits.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("role"),
                          F.col("audit").alias("text"), *longs)
    lines = rows.where(~F.col("gone")).select("conv_id", "pos", "role", "text",
                                              *(F.lit(None).cast("long").alias(c) for c in longs))
    names = ["conv_id", "audit", "repaired_sha256", *longs]

    def run(batches):
        head, repair, done = None, None, []

        def result():
            return (head[0], repair.audit, repair.end(), *head[1:])

        for b in batches:
            pos, role, text = (b.column(c).to_pylist() for c in ("pos", "role", "text"))
            for i, p in enumerate(pos):
                if p == 0:
                    if head:
                        done.append(result())
                    head, repair = [b.column(c)[i].as_py() for c in ("conv_id", *longs)], Repair(text[i])
                else:
                    repair.row(role[i], text[i])
            yield from rows_out(done, names, b.column("conv_id").type, 3)
            done, kind_of_id = [], b.column("conv_id").type
        if head:
            yield from rows_out([result()], names, kind_of_id, 3)

    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return both.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string, " + ", ".join(f"{c} long" for c in longs))


def repair_structure(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) -> one row a conversation; a conversation may have only rows that are gone."""
    rows = materialize(ordered(rows), "conv-rows")
    per = materialize(profiles(rows.repartition("conv_id")), "conv-profiles")
    best = materialize(solved(per.select("sig").distinct()), "conv-solved")
    audits = per.join(best.withColumnRenamed("sig", "s"), F.col("sig") == F.col("s")).drop("sig", "s")
    return repaired(rows, audits)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_structure(damaged(table(spark, sf_dir, "conversations")))


# crc32 of an ASCII text, bit by bit (the polynomial of zlib, reversed)
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1),
  lambda i: ord(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(
    [xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


def _option(cost: str, edit: str, line: str, to: str, state: str) -> str:
    return (f"{{'c': {cost} + ({to})[{state}].c, 'a': '{edit}' || ({to})[{state}].a, "
            f"'t': list_concat({line}, ({to})[{state}].t)}}")


def _oracle() -> str:
    """The same repair as a recursion from the last row of every conversation, audits and texts carried along."""
    inf = "{'c': 1000000000::BIGINT, 'a': '~', 't': []::VARCHAR[]}"
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    base = []
    for s in range(4):
        keep = " ".join(f"WHEN initial = '{r}' THEN " + _option(extra, "K", "[role || ':' || text]", "best", str(to + 1))
                        for r, to in KEPT[s].items())
        base.append("list_min([" + _option("4", "D", "[]::VARCHAR[]", "best", str(s + 1))
                    + f", CASE WHEN fault IN ('blank', 'duplicate') THEN {inf} ELSE "
                    + _option(f"3 + {extra}", "R", f"['{WANTED[s]}:' || text]", "best", str(MOVES[s] + 1)) + " END"
                    + f", CASE WHEN fault IN ('blank', 'duplicate') THEN {inf} {keep} ELSE {inf} END])")

    def add(frm: str, s: int, line: str) -> str:
        return f"list_min([({frm})[{s + 1}], " + _option("3", "I", f"['{line}:']", frm, str(MOVES[s] + 1)) + "])"
    closed = "[" + ", ".join([add("two", 0, "user"), add("two", 1, "user"), "two[3]", "two[4]"]) + "]"
    two = "[base[1], base[2], " + add("base", 2, "assistant") + ", " + add("base", 3, "user") + "]"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), h AS (SELECT *, {_CRC.format("key")} % 20 AS code FROM k
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE code <> 0
), placed AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged
), r AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
), go AS (
  SELECT conv_id, n + 1 AS pos, [{{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}},
    {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']}},
    {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}] AS best FROM r WHERE pos = 1
  UNION ALL
  SELECT conv_id, pos, {closed} FROM (SELECT conv_id, pos, {two} AS two FROM (
    SELECT r.conv_id, r.pos, [{", ".join(base)}] AS base
    FROM go JOIN r ON r.conv_id IS NOT DISTINCT FROM go.conv_id AND r.pos = go.pos - 1))
), done AS (SELECT conv_id, best[1] AS b FROM go WHERE pos = 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM i.conv_id"""


QUERIES = {"op12_conversations": op12_conversations}
ORACLES = {"op12_conversations": _oracle()}
