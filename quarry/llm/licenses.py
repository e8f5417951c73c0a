"""Operator 2: license scan with MinHash bands, then exact shingle containment.

Texts are normalised to words.  A template's MinHash signature (24 bands of 2
rows over five-word shingles) names its minimum shingles.  A stretch of a
document that holds both shingles of one of the bands is a candidate; every
candidate is then verified word by word, at any offset: spans from one shared
shingle to another are matches if they contain at least 80 % of the template's
shingles and are at most a quarter longer than the template, which leaves room
for inserted words.

A band is met wherever a window's own signature would match it, whatever the
window's place.  With 80 % of the shingles left, one of the 24 bands is met
with probability 1 - (1 - 0.8^2)^24, above 0.9999999999.

A match starts and ends with a shared shingle.  Of the overlapping spans of a
template the ones that together contain most are taken, whole copies first; of
overlapping matches of one license the best contained, then the longest
template.

Templates are a parameter, by default the short notices below; they are
shared with every task and must stay under ``MAX_TEMPLATE_WORDS`` in all.

Defined results: null and empty texts match nothing; a template of fewer than
five words is one shingle; templates without words are refused; repeated rows
give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table
from quarry.llm.decontaminate import _WORD, words_of

SHINGLE = 5
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8
# a match may have this many times the template's words
ROOM = 1.25
MAX_TEMPLATE_WORDS = 500_000

# fixed values: wording of common public license notices
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
)


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    """Word runs of ``n``; all words as one run if there are fewer."""
    if not words:
        return []
    return [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


def signature(grams) -> tuple[list[int], list[bytes]]:
    """Minimum hash for each of the BANDS * ROWS functions, and the shingle that has it."""
    low, who = [], []
    gs = list(set(grams))
    for k in range(BANDS * ROWS):
        h, g = min((xxhash.xxh64_intdigest(g, k), g) for g in gs)
        low.append(h)
        who.append(g)
    return low, who


class Templates:
    """Bands, key shingles and shingle sets of the templates."""

    def __init__(self, templates):
        self.rows = []  # (name, words, shingle set, bands)
        self.keys: dict[bytes, set[int]] = {}
        for name, text in templates:
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"template {name!r} has no words")
            grams = shingles(words)
            _, who = signature(grams)
            bands = {frozenset(who[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)}
            for g in who:
                self.keys.setdefault(g, set()).add(len(self.rows))
            self.rows.append((name, len(words), frozenset(grams), bands))
        # a short template is a shingle of its own length
        self.lengths = sorted({min(SHINGLE, n) for _, n, _, _ in self.rows})
        self.first = {g.split(b" ", 1)[0] for g in self.keys}

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(name, first word, last word, containment) of verified matches, best per place."""
        hits: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            if w in self.first:
                for n in self.lengths:
                    g = b" ".join(words[i:i + n])
                    for t in self.keys.get(g, ()):
                        hits.setdefault(t, []).append((i, g))
        found: dict[str, list[tuple[float, int, int, int]]] = {}
        for t, at in hits.items():
            name, n, want, bands = self.rows[t]
            limit = int(n * ROOM)
            for lo, hi, keys in stretches(at, limit):
                if any(b <= keys for b in bands):
                    lo = max(0, lo)
                    found.setdefault(name, []).extend(
                        (c, n, lo + a, lo + z) for c, a, z in verified(words[lo:hi], n, want, limit))
        out = []
        for name, spans in found.items():
            taken: list[tuple[int, int]] = []  # in order and apart
            for c, _, a, z in sorted(spans, key=lambda x: (-x[0], -x[1], x[2])):
                k = bisect.bisect(taken, (a, z))
                if not (k and taken[k - 1][1] >= a or k < len(taken) and taken[k][0] <= z):
                    taken.insert(k, (a, z))
                    out.append((name, a, z, c))
        return sorted(out)


def stretches(at: list[tuple[int, bytes]], limit: int):
    """Word ranges around key shingles (place, shingle), and the shingles of each.

    Every span of ``limit`` words that holds a key shingle lies in one range.
    """
    lo, last, keys = at[0][0] - limit, at[0][0], set()
    for i, g in at:
        if i - last > 2 * limit:
            yield lo, last + limit + 1, keys
            lo, keys = i - limit, set()
        last = i
        keys.add(g)
    yield lo, last + limit + 1, keys


def verified(words: list[bytes], n: int, want: frozenset, limit: int) -> list[tuple[float, int, int]]:
    """(containment, first word, last word) of spans that contain enough of ``want``; none overlap."""
    k = min(SHINGLE, n)
    at = [(i, g) for i, g in enumerate(shingles(words, k)) if g in want]
    spans, count, left = [], Counter(), 0
    for i, g in at:
        count[g] += 1
        # the shortest span that ends here and holds as much as any within the limit
        while i + k - at[left][0] > limit or count[at[left][1]] > 1:
            count[at[left][1]] -= 1
            if not count[at[left][1]]:
                del count[at[left][1]]
            left += 1
        c = len(count) / len(want)
        if c >= CONTAINMENT:
            spans.append((c, at[left][0], i + k - 1))
    whole, end = [], -1
    for c, a, z in spans:
        if c == 1.0 and z - a < n and a > end:
            whole.append((c, a, z))
            end = z
    rest, j = [], 0
    for s in spans:  # starts and ends both rise
        while j < len(whole) and whole[j][2] < s[1]:
            j += 1
        if j == len(whole) or whole[j][1] > s[2]:
            rest.append(s)
    # best total containment of spans apart, then fewest words
    ends = [z for _, _, z in rest]
    best: list[tuple[float, int]] = [(0.0, 0)]
    back: list[int | None] = []
    for q, (c, a, z) in enumerate(rest):
        p = bisect.bisect_left(ends, a, 0, q)
        with_it = (best[p][0] + c, best[p][1] - (z - a + 1))
        back.append(p if with_it > best[q] else None)
        best.append(max(with_it, best[q]))
    q = len(rest)
    while q:
        if back[q - 1] is None:
            q -= 1
        else:
            whole.append(rest[q - 1])
            q = back[q - 1]
    return whole


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("containment", pa.float64())]))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id and matches: license, start and end (code points of the original), containment."""
    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("templates exceed MAX_TEMPLATE_WORDS; scan them in several calls")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast({"templates": templates})

    def run(batches):
        t = shared.value
        if "built" not in t:  # once for a worker process
            t["built"] = Templates(t["templates"])
        built = t["built"]
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                found = built.matches(words_of(text or b""))
                if found:
                    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "surrogatepass"))]
                    found = [{"license": n, "start": at[i][0], "end": at[j][1], "containment": c}
                             for n, i, j, c in found]
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, _MATCH)], names=["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, matches array<struct<license:string,start:bigint,end:bigint,containment:double>>")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(
        ":", m["license"], m["start"].cast("string"), m["end"].cast("string")))
    return d.select("doc_id", F.size("matches").cast("long").alias("n_matches"),
                    F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
                    F.array_join(spans, ",").alias("spans"),
                    F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0)).alias("containment"))


QUERIES = {"op2_licenses": op2_licenses}
