"""Operator 13: phrase collocations from FM-indexes over word ids, one index a shard.

Tasks read documents into pieces (one language, a bounded number of words) and
give every word a number within its piece.  Words seen ``LEAST`` times in the
whole language get a number for good; all others part phrases just as piece
ends do, as no frequent phrase holds them.  Pieces of a language are dealt to
shards of about ``SHARD_WORDS`` words, and each shard is indexed once: the
Burrows-Wheeler transforms of its word numbers read forwards and backwards,
sorted by the next four words, as no longer phrase is asked for.  A phrase is
an interval in both; adding a word at either end is a step of the backward
search in one transform and a shift in the other, done for many phrases of one
length at once, and gives the phrase's counts with each extension.

First every shard extends its words to the right: the pairs.  It deals them by
hash to as many buckets as its language has shards and sends each bucket one
packet, the numbers and counts of its pairs packed by column.  A bucket adds up
the packets of all shards and answers each with one bit a pair: frequent or
not.  The shard then extends its frequent pairs to the right and then to the
left, keeps only phrases all of whose pairs are frequent, and these are added up
in buckets likewise.  So a rare phrase costs a few packed bytes a shard and no
row of its own, only frequent ones become rows, and longer phrases are counted
only where they can be frequent.  Sums are exact.

A phrase lies inside a longer frequent one exactly if it has a one-word
extension as frequent as the longer one, so extensions by one word decide what
is dropped.

Defined results: a null text is empty and has no words; a null lang is ``und``;
repeated rows count each; ties are broken as the contract says, down to the
phrase itself.  A very long text is a piece of its own size.  An empty table
gives no rows.  Other columns, whatever their names, are not read.

Scale: a shard is bounded, so a language on a third of all rows has a third of
the shards and of the buckets; a bucket holds about ``SHARD_WORDS`` packed
phrases, dealt by the hash of the whole phrase.  Every table between is keyed by
word, bucket, phrase or shard, with one row a shard (words: a piece) at most for
a key, so neither a word, a pair nor a language gathers in one task.  Packets
are as many as shards times buckets of a language, and never more than phrases.
Only the table of languages is numbered in one task.  Nothing is collected or
broadcast by this code.
"""

from __future__ import annotations

import functools
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import collecting, drop_tables, materialize, small_batches, table
from quarry.operators.ordinal import with_ordinal

LEAST = 30            # occurrences of a phrase
TOP = 2000            # phrases of a language
INSIDE = 80           # per cent: a phrase is dropped if a longer one has as many of its occurrences
SHARD_WORDS = 1 << 21
PIECE_WORDS = 1 << 20
ROWS = 1 << 18        # of a transform, extended at once
DEPTH = 4             # words of a phrase
BATCH_BYTES = 4 << 20  # of texts or indexes sent to Python at once
# Every piece end becomes the first of them, every tab a space; upper case becomes lower.
ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes(b"."[0] if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words(dict):
    """Numbers words from 1 as they are met; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def tokens(text: str) -> list[bytes]:
    """Words of a text, with a ``.`` where a piece ends."""
    return [w for w in text.encode().translate(FOLD).replace(b".", b" . ").split(b" ") if w]


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def packed_rows(columns: list[np.ndarray]) -> bytes:
    """Columns of long numbers; the first bytes of a column's numbers lie together, then the second ones and so on."""
    return packed(np.stack(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))


def unpacked_rows(data: bytes, columns: int, n: int) -> np.ndarray:
    turned = unpacked(data, np.uint8, columns * n * 8).reshape(columns, 8, n).transpose(0, 2, 1)
    return np.ascontiguousarray(turned).view(np.int64).reshape(columns, n)


class Piece:
    def __init__(self):
        self.words, self.text = Words({b".": 0}), array("i", [0])

    def add(self, text: str) -> None:
        self.text.extend(map(self.words.__getitem__, tokens(text)))
        self.text.append(0)


def pieces(docs: DataFrame, size: int = PIECE_WORDS) -> DataFrame:
    """(piece, lang, words, counts, total, size, text): the numbered words of the documents."""
    kinds = "lang string, words array<binary>, counts array<long>, total long, size long, text binary"

    def run(batches) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Piece] = {}

        def close(lang: str) -> pa.RecordBatch:
            p = open_.pop(lang)
            t = np.frombuffer(p.text, np.int32)
            counts = np.bincount(t, minlength=len(p.words))[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([list(p.words)[1:]], pa.list_(pa.binary())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([int(counts.sum())], pa.int64()),
                 pa.array([len(t)], pa.int64()), pa.array([packed(t)], pa.binary())],
                names=["lang", "words", "counts", "total", "size", "text"])

        for b in batches:
            for r in (r for i in range(0, b.num_rows, 256) for r in b.slice(i, 256).to_pylist()):
                lang, text = r["lang"], r["text"]
                piece = open_.setdefault(lang, Piece())
                piece.add(text)
                if len(piece.text) >= size:
                    yield close(lang)
                elif len(open_) > 4 and sum(len(p.text) for p in open_.values()) >= 4 * size:
                    yield close(max(open_, key=lambda k: len(open_[k].text)))
        for lang in list(open_):
            yield close(lang)

    some = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    return some.mapInArrow(run, kinds).withColumn("piece", F.monotonically_increasing_id())


def by_next_words(t: np.ndarray) -> np.ndarray:
    """Positions of the text by the ``DEPTH`` words from there on, equal ones by position: the last word is sorted first."""
    order = np.arange(len(t))
    for n in reversed(range(DEPTH)):
        ahead = np.zeros(len(t), t.dtype)
        ahead[:max(0, len(t) - n)] = t[n:]
        order = order[np.argsort(ahead[order], kind="stable")]
    return order


def transform(t: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of the text: the word before each of the sorted positions."""
    return t[by_next_words(t) - 1]


def groups(size: np.ndarray) -> list[int]:
    """Where to cut the intervals so that each part has about ``ROWS`` rows."""
    return [0, *np.flatnonzero(np.diff((np.cumsum(size) - 1) // ROWS)) + 1, len(size)] if len(size) else []


class FMIndex:
    """One transform with its counts: steps of the backward search for many intervals at once."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        self.bwt, self.sigma = bwt, sigma
        self.count = np.bincount(bwt, minlength=sigma + 1)
        self.start = np.cumsum(self.count) - self.count

    @functools.cached_property
    def places(self) -> np.ndarray:
        """Where every word stands in the transform: word * length + row, ascending."""
        out = np.repeat(np.arange(self.sigma + 1) * len(self.bwt), self.count)
        out += np.argsort(self.bwt, kind="stable")
        return out

    def before(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of the words in the transform before the rows."""
        return np.searchsorted(self.places, word * len(self.bwt) + row) - self.start[word]

    def counts(self, low: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        """All one-word extensions of the intervals at this transform's end, some intervals at a time.

        Yields (which interval, word, count, count of smaller words and ends in the interval), words in order.
        """
        for i, j in itertools.pairwise(groups(size)):
            ends = np.cumsum(size[i:j])
            rows = np.repeat(low[i:j] - (ends - size[i:j]), size[i:j]) + np.arange(ends[-1])
            owner = np.repeat(np.arange(i, j), size[i:j])
            key, n = np.unique(owner * (self.sigma + 1) + self.bwt[rows], return_counts=True)
            owner, word = key // (self.sigma + 1), key % (self.sigma + 1)
            below = np.cumsum(n) - n
            first = np.r_[True, owner[1:] != owner[:-1]][:len(owner)]
            below = below - np.repeat(below[first], np.diff(np.r_[np.flatnonzero(first), len(owner)]))
            real = word > 0
            yield owner[real], word[real], n[real], below[real]

    def extensions(self, low: np.ndarray, size: np.ndarray, keep) -> list[np.ndarray]:
        """All at once, as ``counts`` has them, those that ``keep``."""
        found = [(np.zeros(0, np.int64),) * 4]
        for owner, word, n, below in self.counts(low, size):
            ok = keep(owner, word)
            found.append((owner[ok], word[ok], n[ok], below[ok]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, keep) -> tuple[np.ndarray, ...]:
        """The extensions (which interval, word, count) that ``keep``, and their intervals.

        ``other`` holds the starts in the opposite transform.  Returns (which
        interval, word, count, low, other).
        """
        owner, word, n, below = self.extensions(low, size, keep)
        return owner, word, n, self.start[word] + self.before(word, low[owner]), other[owner] + below


class Phrases:
    """The bidirectional index of one shard: forward and backward transforms in step."""

    def __init__(self, ahead: np.ndarray, back: np.ndarray, sigma: int):
        self.left, self.right, self.sigma = FMIndex(ahead, sigma), FMIndex(back, sigma), sigma

    def pairs(self) -> Iterator[tuple]:
        """(first, second, count) of all pairs of words, some at a time."""
        for own, second, n, _ in self.right.counts(self.right.start[1:], self.right.count[1:]):
            yield own + 1, second, n

    def longer(self, frequent: np.ndarray) -> list[np.ndarray]:
        """Four words (the last 0 if there are three) and counts of the phrases all of whose pairs are frequent.

        ``frequent``: sorted keys first * (sigma + 1) + second.
        """
        def known(a, b):
            if not len(frequent):
                return np.zeros(len(a), bool)
            key = a * (self.sigma + 1) + b
            return frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
        found = [(np.zeros(0, np.int32),) * 4 + (np.zeros(0, np.int64),)]
        for i, j in itertools.pairwise(groups(self.left.count[1:])):  # some first words at a time
            at = self.left.start[i + 1:j + 1]
            a, b, n, back, low = self.right.extend(at, at, self.left.count[i + 1:j + 1], lambda own, w, i=i: known(own + i + 1, w))
            a += i + 1
            own, c, n, below = self.right.extensions(back, n, lambda own, w, b=b: known(b[own], w))
            three = a[own], b[own], c
            own, first, m, _ = self.left.extensions(low[own] + below, n, lambda own, w, a=three[0]: known(w, a[own]))
            found.append((*(x.astype(np.int32) for x in (*three, np.zeros_like(c))), n))
            found.append((*(x.astype(np.int32) for x in (first, *(x[own] for x in three))), m))
        return [np.concatenate(x) for x in zip(*found, strict=True)]


def indexes(pieces_: DataFrame, numbers: DataFrame) -> DataFrame:
    """(shard, base, shards, ids, words, size, ahead, back): both transforms of every shard.

    ids[i] is the number for good of its word i + 1; its language has the shards from ``base`` on.

    ``numbers``: (shard, piece, j, id) of the frequent words of every piece.
    """

    def run(parts: pa.Table, known: pa.Table) -> pa.Table:
        piece, j, own = (known.column(c).to_numpy() for c in ("piece", "j", "id"))
        ids = np.unique(own)
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        text = [np.zeros(1, kind)]
        for r in parts.to_pylist():
            t, mine = unpacked(r["text"], np.int32, r["size"]), piece == r["piece"]
            new = np.zeros(int(t.max(initial=0)) + 1, kind)
            new[j[mine] + 1] = np.searchsorted(ids, own[mine]) + 1
            text.append(new[t])
        t = np.concatenate(text)
        t = t[np.r_[True, (t[1:] != 0) | (t[:-1] != 0)]]  # one end is enough
        return pa.table({**{c: parts.column(c)[:1] for c in ("shard", "base", "shards")}, "ids": pa.array([packed(ids)]), "words": pa.array([len(ids)], pa.int64()),
                         "size": pa.array([len(t)], pa.int64()), "ahead": pa.array([packed(transform(t))]),
                         "back": pa.array([packed(transform(t[::-1]))])})

    numbers = numbers.select(*(F.col(c).alias(c) for c in ("shard", "piece", "j", "id")))  # of their own in the plan
    return pieces_.select("shard", "base", "shards", "piece", "size", "text").groupBy("shard").cogroup(numbers.groupBy("shard")).applyInArrow(
        run, "shard long, base long, shards long, ids binary, words long, size long, ahead binary, back binary")


def opened(row: dict) -> tuple[np.ndarray, Phrases]:
    n = row["words"]
    kind = np.uint16 if n < 1 << 16 else np.uint32
    ahead, back = (unpacked(row[c], kind, row["size"]) for c in ("ahead", "back"))
    return np.r_[0, unpacked(row["ids"], np.int64, n)], Phrases(ahead, back, n)


W = ("w1", "w2", "w3", "w4")
PACKET = "shard long, bucket long, n long, data binary"


def dealt(ids: np.ndarray, columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, which rows) of the buckets that have rows, by hash of the numbers for good of a phrase; rows in order."""
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h ^= ids[x].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    at = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(np.bincount(at, minlength=buckets))
    for b, (i, j) in enumerate(itertools.pairwise([0, *ends.tolist()])):
        if i < j:
            yield b, order[i:j]


def packets(shard: int, base: int, buckets: int, ids: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    """One row for every bucket: the numbers for good and the counts of its phrases."""
    rows = [(shard, base + b, len(at), packed_rows([*(ids[x[at]] for x in columns), n[at]]))
            for b, at in dealt(ids, columns, buckets)]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["shard", "bucket", "n", "data"])


def all_pairs(phrases: Phrases) -> list[np.ndarray]:
    """(first, second, count) of all pairs of words of a shard, in order."""
    return [np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *phrases.pairs(), strict=True)]


def pair_counts(index: DataFrame) -> DataFrame:
    """(shard, bucket, n, data): the pairs of every shard, a packet for every bucket."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                ids, phrases = opened(r)
                a, c, n = all_pairs(phrases)
                yield packets(r["shard"], r["base"], r["shards"], ids, [a, c], n)

    return index.mapInArrow(run, PACKET)


def frequent_pairs(row: dict, ids: np.ndarray, phrases: Phrases, bits: dict[int, bytes]) -> np.ndarray:
    """Sorted keys of a shard's pairs whose bit is set; ``bits`` by bucket, a bit a pair of the packet."""
    a, c, _ = all_pairs(phrases)
    often = np.zeros(len(a), bool)
    for b, at in dealt(ids, [a, c], row["shards"]):
        if b in bits:
            often[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(at))
    return a[often] * len(ids) + c[often]


def longer_counts(index: DataFrame, answers: DataFrame) -> DataFrame:
    """(shard, bucket, n, data): packets of the longer phrases of every shard whose pairs are all frequent.

    ``answers``: (shard, bucket, often) to the packets of pairs, a bit a pair; w4 is 0 where there are three words.
    """

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows) or not len(answers):
            return pa.table({c: pa.array([], t) for c, t in (("shard", pa.int64()), ("bucket", pa.int64()),
                                                             ("n", pa.int64()), ("data", pa.binary()))})
        r = rows.to_pylist()[0]
        ids, phrases = opened(r)
        bits = {x["bucket"] - r["base"]: x["often"] for x in answers.select(["bucket", "often"]).to_pylist()}
        *w, n = phrases.longer(frequent_pairs(r, ids, phrases, bits))
        # there may be more longer phrases than pairs, and they have more words
        return pa.Table.from_batches([packets(r["shard"], 4 * r["base"], 4 * r["shards"], ids, w, n)])

    return index.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, PACKET)


def numbered(x: np.ndarray) -> np.ndarray:
    """Equal numbers get the same number, from 0 as they are met."""
    return pa.array(x).dictionary_encode().indices.to_numpy().astype(np.int64)


def sums(sent: DataFrame, least: int, words: int, answer: bool = False) -> DataFrame:
    """(w1..w4, f) of the frequent phrases of ``words`` columns in all packets, absent words 0.

    If ``answer``, also a row (shard, bucket, often) for every packet that has some: a bit a phrase, in its order.
    """
    kinds = [("shard", pa.int64()), ("bucket", pa.int64()), ("often", pa.binary()), *((c, pa.int64()) for c in (*W, "f"))]

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("n").to_pylist()
        ends = np.cumsum(size)
        *w, n = x = np.empty((words + 1, ends[-1]), np.int64)
        for d, m, end in zip(rows.column("data"), size, ends, strict=True):
            x[:, end - m:end] = unpacked_rows(d.as_py(), words + 1, m)
        code = numbered(w[0])
        for x in w[1:]:
            x = numbered(x)
            code = numbered(code * (x.max() + 1) + x)
        total, at = np.zeros((2, code.max() + 1), np.int64)
        np.add.at(total, code, n)
        at[code] = np.arange(len(code))
        often = total >= least
        at = at[often]
        none = np.zeros(len(at), np.int64)
        found = pa.table({c: pa.array(x) for c, x in zip((*W, "f"), (
            *(x[at] for x in w), *[none] * (DEPTH - words), total[often]), strict=True)})
        parts = found.to_batches(1 << 16)  # sent in small batches
        if answer:
            bits = np.split(often[code], ends[:-1])
            some = [(s, b, np.packbits(x).tobytes()) for s, b, x in zip(
                rows.column("shard").to_pylist(), rows.column("bucket").to_pylist(), bits, strict=True) if x.any()]
            parts.append(pa.RecordBatch.from_pydict({c: [x[i] for x in some] for i, c in enumerate(("shard", "bucket", "often"))},
                                                    schema=pa.schema(kinds[:3])))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(
            [p.column(c) if c in p.schema.names else pa.nulls(p.num_rows, t) for c, t in kinds], names=[c for c, _ in kinds])
            for p in parts], pa.schema(kinds))

    return sent.groupBy("bucket").applyInArrow(
        run, "shard long, bucket long, often binary, w1 long, w2 long, w3 long, w4 long, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = SHARD_WORDS,
                  piece: int = PIECE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (id, lang, word, f) of the frequent words and (w1..w4, f) of the frequent phrases, absent words 0."""
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    with collecting(used := []):
        parts = materialize(pieces(docs, piece), "phrase-pieces")
    totals = parts.groupBy("lang").agg(F.sum("total").alias("n"), F.sum("size").alias("s"))
    totals = totals.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.round(F.col("s") / size).cast("long")))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)  # a row a language
    totals = materialize(totals.withColumn("base", F.coalesce(F.sum("shards").over(before), F.lit(0))), "phrase-langs")
    shard = (F.col("base") + F.pmod(F.xxhash64("piece"), F.col("shards"))).alias("shard")
    parts = parts.join(totals.select("lang", "shards", "base"), "lang").select(
        shard, "base", "shards", "piece", "lang", "words", "counts", "size", "text")
    each = parts.select("shard", "piece", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("j", "x")).select(
        "shard", "piece", "lang", F.col("j").cast("long").alias("j"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = materialize(each.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
                        .withColumn("id", F.monotonically_increasing_id() + 1), "phrase-words")
    own = each.drop("c").join(words.select("lang", "word", "id"), ["lang", "word"]).select("shard", "piece", "j", "id")
    index = materialize(indexes(parts, own), "phrase-index")
    drop_tables(docs.sparkSession, used)  # all that follows reads the index
    pairs = materialize(sums(pair_counts(index), least, 2, answer=True), "phrase-pairs")
    answers = pairs.where(F.col("shard").isNotNull()).select("shard", "bucket", "often")
    longer = sums(longer_counts(index, answers), least, DEPTH).select(*W, "f")
    two = pairs.where(F.col("shard").isNull()).select(*W, "f")
    return totals.select("lang", "n"), words, materialize(two.unionByName(longer), "phrases")


def _phrase(*w: Column) -> Column:
    w = [*w, *[F.lit(0).cast("long")] * (DEPTH - len(w))]
    return F.struct(*(x.alias(n) for x, n in zip(w, W, strict=True)))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE,
                 size: int = SHARD_WORDS, piece: int = PIECE_WORDS) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    totals, words, phrases = phrase_counts(docs, least, size, piece)
    w = [F.col(c) for c in W]
    long4, long3 = F.col("w4") > 0, F.col("w3") > 0
    # one-word extensions: the phrase without its last or its first word
    shorter = phrases.where(long3).select("f", F.explode(
        F.when(long4, F.array(_phrase(*w[:3]), _phrase(*w[1:]))).otherwise(
            F.array(_phrase(*w[:2]), _phrase(*w[1:3])))).alias("p")).groupBy("p").agg(F.max("f").alias("longer"))
    shorter = shorter.select(*(F.col(f"p.{c}").alias(c) for c in W), "longer")
    hundred, a = F.lit(100).cast("decimal(10,0)"), F.col("f").cast("decimal(20,0)")
    held = hundred * F.col("longer").cast("decimal(20,0)") >= F.lit(inside).cast("decimal(10,0)") * a
    kept = phrases.join(shorter, list(W), "left").where(~F.coalesce(held, F.lit(False))).drop("longer")
    cut = F.struct
    two = F.array(cut(F.lit(1).alias("k"), _phrase(w[0]).alias("p"), _phrase(w[1]).alias("q")))
    three = F.array(cut(F.lit(1).alias("k"), _phrase(w[0]).alias("p"), _phrase(*w[1:3]).alias("q")),
                    cut(F.lit(2).alias("k"), _phrase(*w[:2]).alias("p"), _phrase(w[2]).alias("q")))
    four = F.array(*(cut(F.lit(k).alias("k"), _phrase(*w[:k]).alias("p"), _phrase(*w[k:]).alias("q")) for k in (1, 2, 3)))
    cuts = kept.select(*W, "f", F.explode(F.when(long4, four).when(long3, three).otherwise(two)).alias("c")).select(
        *W, "f", "c.k", *(F.col(f"c.{s}.{x}").alias(f"{s}{x}") for s in "pq" for x in W[:3]))
    parts = words.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(x) for x in W[1:3]), "f").unionByName(
        phrases.where(~long4).select(*W[:3], "f"))
    for side, name in (("p", "l"), ("q", "r")):
        known = parts.select(*(F.col(x).alias(f"{side}{x}") for x in W[:3]), F.col("f").alias(name))
        cuts = cuts.join(known, [f"{side}{x}" for x in W[:3]])
    score = F.expr("CAST(2000000 AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) DIV "
                   "(CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.withColumn("score", score).groupBy(*W, F.col("f").alias("a")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"))
    named = best.select(*W, "a", "m.l", "m.r", F.col("m.score").cast("long").alias("score"))
    for i, x in enumerate(W):
        names = words.select(F.col("id").alias(x), F.col("word").cast("string").alias(f"t{i}"), *(["lang"] if not i else []))
        named = named.join(names, x, "inner" if i < 2 else "left")
    named = named.select("lang", F.concat_ws(" ", "t0", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    named = named.withColumns({"down": -F.col("score"), "fewer": -F.col("a")})
    placed = with_ordinal(named, "lang", ["down", "fewer", "phrase"], "rank").where(F.col("rank") <= top)
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), q AS (SELECT row_number() OVER () AS q, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang
), t AS (SELECT q, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q
), o AS (
  SELECT lang, x AS a, lead(x, 1) OVER s AS b, lead(x, 2) OVER s AS c, lead(x, 3) OVER s AS d
  FROM t WINDOW s AS (PARTITION BY q ORDER BY i)
), f AS (
  SELECT lang, [a] AS g, 1 AS k, count(*) AS f FROM o GROUP BY lang, a HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b], 2, count(*) FROM o WHERE b IS NOT NULL GROUP BY lang, a, b HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b, c], 3, count(*) FROM o WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING count(*) >= 30
  UNION ALL SELECT lang, [a, b, c, d], 4, count(*) FROM o WHERE d IS NOT NULL GROUP BY lang, a, b, c, d HAVING count(*) >= 30
), longer AS (
  SELECT lang, sub, max(f) AS f FROM (
    SELECT lang, unnest([g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]]) AS sub, k, f FROM f WHERE k > 2)
  WHERE len(sub) >= 2 AND len(sub) < k GROUP BY lang, sub
), kept AS (
  SELECT f.* FROM f LEFT JOIN longer ON longer.lang = f.lang AND longer.sub = f.g
  WHERE f.k > 1 AND NOT coalesce(100 * longer.f >= 80 * f.f, false)
), cut AS (
  SELECT kept.lang, kept.g, kept.f AS a, c, l.f AS l, r.f AS r,
    (2000000::HUGEINT * kept.f) // (l.f + r.f) AS score
  FROM kept, (SELECT unnest([1, 2, 3]) AS c)
  JOIN f l ON l.lang = kept.lang AND l.g = kept.g[1:c]
  JOIN f r ON r.lang = kept.lang AND r.g = kept.g[c + 1:kept.k]
  WHERE c < kept.k
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM low
)
SELECT ranked.lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""}
