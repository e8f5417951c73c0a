"""Operator 4: language-model scores by context-tree weighting.

Every byte is eight binary decisions.  A decision's context is the path of
bits already known in its byte and up to ``DEPTH`` bytes before it.  Each node
of the context tree holds a Krichevsky-Trofimov estimate of its decision and
the weighted probability of its subtree, half from its own estimate and half
from the product of its children.  A document's score mixes the estimates of
all depths along its path with the weights learned from the training
documents; it is the log10 probability of the normalised text: words (A-Z
lower-cased) joined by one space, then an end byte.

The model is never held whole.  Texts are cut into blocks; a block sends its
distinct byte runs of DEPTH + 1 with their training counts, packed by bucket
of their two nearest context bytes.  A bucket is summed over the corpus in two
steps (first over a share of the blocks, so that a bucket with much traffic is
split) and then owns whole subtrees from depth two down.  Depth one and zero
are at most 256 x 255 nodes, weighted from partial sums and shared with every
task.  Each block gets back the log probabilities of its own runs only.  A
token unigram with add-0.1 counts is scored the same way, as base.

Defined results: null text is empty, one end token and one end byte; a null id
hashes as the empty text (remainder 0: held out); without training documents
every decision has probability one half; repeated rows are scored and learned
as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, materialize, small_batches, table

DEPTH = 5
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 2 << 20
# Buckets of runs and tokens, at most; and the shares a bucket's traffic is split into.
BUCKETS = 1024
SHARES = 4
_HALF = float(np.log(0.5))


def normal(text: bytes) -> tuple[bytes, list[bytes]]:
    """Bytes that are scored, and the tokens without the end."""
    words = text.lower().split()
    return b" ".join(words) + b"\n", words


def run_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): for every byte its context and itself in one number.

    The nearest context byte is highest, the byte itself lowest, so numeric
    order is the order of the context tree.  Before a text stand end bytes.
    """
    pad = b"\n" * DEPTH
    a = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n = len(a) - DEPTH
    key = a[DEPTH:].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= a[DEPTH - d:DEPTH - d + n].astype(np.uint64) << np.uint64(8 * (DEPTH - d + 1))
    real = np.ones(n, dtype=bool)
    ends = np.cumsum(sizes + DEPTH)[:-1]
    for j in range(DEPTH):
        real[ends - DEPTH + j] = False
    return key[real], sizes


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(inv, weights=np.concatenate([n for _, n in parts]), minlength=len(uniq)).astype(np.int64)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, byte plane by byte plane."""
    return squeeze(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def run_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a run: a hash of its two nearest context bytes."""
    near = keys >> np.uint64(8 * (DEPTH - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


class Block:
    """Distinct runs and tokens of up to BLOCK_BYTES of text, with training counts."""

    def __init__(self):
        self.bytes = 0
        self.parts: list = []
        self.waiting: tuple[list[bytes], list[bytes]] = ([], [])
        self.wait_bytes = 0
        self.words: Counter = Counter()
        self.other: set[bytes] = set()

    def add(self, text: bytes, words: list[bytes], train: bool) -> None:
        self.waiting[train].append(text)
        self.wait_bytes += len(text)
        self.bytes += len(text)
        if train:
            self.words.update(words)
        else:
            self.other.update(words)
        if self.wait_bytes >= CHUNK_BYTES:
            self.flush()

    def flush(self) -> None:
        for train, texts in enumerate(self.waiting):
            if texts:
                k, n = np.unique(run_keys(texts)[0], return_counts=True)
                self.parts.append((k, n if train else np.zeros(len(k), dtype=np.int64)))
        self.waiting, self.wait_bytes = ([], []), 0
        if len(self.parts) > 6:
            self.parts = [merge_counts(self.parts)]

    def packed(self, buckets: int):
        """(kind, bucket, keys or words, counts) of all buckets that hold any."""
        self.flush()
        keys, n = merge_counts(self.parts)
        at = run_buckets(keys, buckets)
        order = np.argsort(at, kind="stable")
        keys, n, at = keys[order], n[order], at[order]
        for i, j in zip(*_runs(at), strict=True):
            yield 1, int(at[i]), pack_sorted(keys[i:j]), pack(n[i:j])
        by: dict[int, list[tuple[bytes, int]]] = {}
        for w in self.other:
            self.words.setdefault(w, 0)
        for w, c in self.words.items():
            by.setdefault(zlib.crc32(w) % buckets, []).append((w, c))
        for b, pairs in by.items():
            pairs.sort()
            yield 2, b, squeeze(b"\n".join(w for w, _ in pairs)), pack(np.array([c for _, c in pairs], np.int64))


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal values."""
    cut = np.flatnonzero(np.diff(a)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(a)]])


_COLS = ["block", "kind", "bucket", "ids", "train", "tokens", "a", "b"]


def _table(rows: list[tuple], id_type) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()),
             pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_COLS)


def blocks_of(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packed rows of kind 0 (normalised texts), 1 (runs) and 2 (tokens), by block; written once."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        block, texts, ids, train, tokens, held, id_type = Block(), [], [], [], [], 0, None

        def text_row():
            return ((part << 20) | seq, 0, None, list(ids), list(train), list(tokens), squeeze(b"".join(texts)), None)

        def block_rows():
            for kind, bucket, a, b in block.packed(buckets):
                yield ((part << 20) | seq, kind, bucket, None, None, None, a, b)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, t, tr in zip(batch.column("doc_id").to_pylist(),
                                batch.column("text").cast(pa.binary()).to_pylist(),
                                batch.column("train").to_pylist(), strict=True):
                text, words = normal(t or b"")
                block.add(text, words, tr)
                texts.append(text)
                ids.append(i)
                train.append(tr)
                tokens.append(len(words) + 1)
                held += len(text)
                full = block.bytes >= block_bytes
                if full or held >= CHUNK_BYTES:
                    yield _table([text_row()], id_type)
                    texts, ids, train, tokens, held = [], [], [], [], 0
                if full:
                    for r in block_rows():
                        yield _table([r], id_type)
                    block, seq = Block(), seq + 1
        if texts:
            yield _table([text_row()], id_type)
        if block.bytes:
            rows = list(block_rows())
            for i in range(0, len(rows), 100):
                yield _table(rows[i:i + 100], id_type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text", "train").mapInArrow(
        run, f"block long, kind int, bucket int, ids array<{kind}>, train array<boolean>, tokens array<long>, "
             "a binary, b binary"), "lm-blocks")


def _rows(batches, *cols):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in cols], strict=True)


class Summed:
    """Counts of one bucket: runs as sorted arrays, tokens as a dictionary."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.waiting, self.words = kind, [], 0, Counter()

    def add(self, a: bytes, b: bytes) -> None:
        n = unpack(b, np.int64)
        if self.kind == 1:
            self.parts.append((unpack_sorted(a), n))
            self.waiting += len(n)
            if self.waiting > 2 * len(self.parts[0][1]) + 1_000_000:
                self.parts = [merge_counts(self.parts)]
                self.waiting = 0
        else:
            c = self.words
            for w, k in zip(expand(a).split(b"\n"), n.tolist(), strict=True):
                c[w] = c.get(w, 0) + k

    def packed(self) -> tuple[bytes, bytes]:
        if self.kind == 1:
            k, n = merge_counts(self.parts)
            return pack_sorted(k), pack(n)
        pairs = sorted(self.words.items())
        return squeeze(b"\n".join(w for w, _ in pairs)), pack(np.array([c for _, c in pairs], np.int64))


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """(kind, bucket, a, b): counts added over all rows with equal ``by`` columns."""

    def run(batches):
        at, total = None, None
        for key in _rows(batches, *by, "a", "b"):
            if key[:-2] != at:
                if total is not None:
                    yield _sum_row(at, total)
                at, total = key[:-2], Summed(key[0])
            total.add(key[-2], key[-1])
        if total is not None:
            yield _sum_row(at, total)

    return rows.select(*by, "a", "b").repartition(*by).sortWithinPartitions(*by).mapInArrow(
        run, "kind int, bucket int, a binary, b binary")


def _sum_row(at, total: Summed) -> pa.RecordBatch:
    a, b = total.packed()
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                                       pa.array([a], pa.binary()), pa.array([b], pa.binary())],
                                      names=["kind", "bucket", "a", "b"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0, by Stirling's series beyond 8."""
    x = np.asarray(x, dtype=np.float64)
    low = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low = np.where(small, low * y, low)
        y = np.where(small, y + 1, y)
    z = 1.0 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + tail - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of these counts."""
    return (log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
            - 1.1447298858494002)


class Subtrees:
    """Nodes from depth two down of the runs in one task (sorted distinct keys, counts)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.counts, self.up = {DEPTH: keys}, {DEPTH: n.astype(np.float64)}, {}
        for d in range(DEPTH - 1, 1, -1):
            k = self.keys[d + 1]
            shorter = ((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(255))
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], weights=self.counts[d + 1], minlength=len(self.keys[d]))

    def level(self, d: int, bit: int):
        """Node of every key at this depth and bit: group, first member, bit value, counts."""
        k = self.keys[d]
        node = k >> np.uint64(8 - bit)
        new = np.ones(len(k), dtype=bool)
        new[1:] = node[1:] != node[:-1]
        group = np.cumsum(new) - 1
        value = ((k >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        ones = np.bincount(group, weights=self.counts[d] * value)
        zeros = np.bincount(group, weights=self.counts[d]) - ones
        return group, np.flatnonzero(new), value, zeros, ones

    def weigh(self, bit: int):
        """Per depth the levels with their own weight, and ln weighted probability at depth two."""
        out, below = {}, None
        for d in range(DEPTH, 1, -1):
            group, first, value, zeros, ones = self.level(d, bit)
            kt = log_kt(zeros, ones)
            if below is None:
                weighted, own = kt, np.ones(len(kt))
            else:
                down_first, down = below
                children = np.bincount(group[self.up[d + 1][down_first]], weights=down, minlength=len(kt))
                weighted = np.logaddexp(_HALF + kt, _HALF + children)
                own = np.exp(_HALF + kt - weighted)
            out[d] = (group, value, zeros, ones, own)
            below = (first, weighted)
        return out, below

    def partial(self):
        """(code, zeros, ones, ln weighted) sums for depth-one nodes, code = byte << 8 | 1 and bits."""
        for bit in range(8):
            levels, (first, weighted) = self.weigh(bit)
            _, _, zeros, ones, _ = levels[2]
            k = self.keys[2][first]
            code = ((k >> np.uint64(16)) << np.uint64(8)) | np.uint64(1 << bit) | (
                (k & np.uint64(255)) >> np.uint64(8 - bit))
            u, inv = np.unique(code, return_inverse=True)
            yield u.astype(np.int64), *[np.bincount(inv, weights=w) for w in (zeros, ones, weighted)]

    def log_p(self, top: np.ndarray) -> np.ndarray:
        """log10 probability of every run, given depth one's (p of 0, p of 1, rest) by code."""
        total = np.zeros(len(self.keys[DEPTH]))
        for bit in range(8):
            levels, _ = self.weigh(bit)
            k = self.keys[2]
            code = ((k >> np.uint64(16)) << np.uint64(8)) | np.uint64(1 << bit) | (
                (k & np.uint64(255)) >> np.uint64(8 - bit))
            group, value, zeros, ones, own = levels[2]
            p, rest = top[code, value], top[code, 2]
            for d in range(2, DEPTH + 1):
                group, value, zeros, ones, own = levels[d]
                if d > 2:
                    p, rest = p[self.up[d]], rest[self.up[d]]
                hit = np.where(value == 1, ones[group], zeros[group])
                p = p + rest * own[group] * (hit + 0.5) / (zeros[group] + ones[group] + 1.0)
                rest = rest * (1.0 - own[group])
            total += np.log10(p)
        return total


def top_levels(rows) -> np.ndarray:
    """Depth-one path sums (p of 0, p of 1, rest) by code, from partial sums of all tasks."""
    top = np.zeros((256 * 256, 3))
    r = np.array([tuple(x) for x in rows], dtype=np.float64).reshape(-1, 4)
    code = r[:, 0].astype(np.int64)
    zeros, ones, children = r[:, 1], r[:, 2], r[:, 3]
    kt = log_kt(zeros, ones)
    weighted = np.logaddexp(_HALF + kt, _HALF + children)
    own = np.exp(_HALF + kt - weighted)
    bits = code & 255
    z0, o0, c0 = (np.bincount(bits, weights=w, minlength=256) for w in (zeros, ones, weighted))
    kt0 = log_kt(z0, o0)
    own0 = np.exp(_HALF + kt0 - np.logaddexp(_HALF + kt0, _HALF + c0))
    for v, (n0, n1) in enumerate(((z0, zeros), (o0, ones))):
        root = own0 * (n0 + 0.5) / (z0 + o0 + 1.0)
        top[code, v] = root[bits] + (1 - own0[bits]) * own * (n1 + 0.5) / (zeros + ones + 1.0)
    top[code, 2] = (1 - own0[bits]) * (1 - own)
    return top


def context_tree(counts: DataFrame) -> DataFrame:
    """(kind, bucket, a runs, b log10 probabilities) from summed rows of kind 1."""

    def partial(batches):
        for a, b in _rows(batches, "a", "b"):
            for code, zeros, ones, weighted in Subtrees(unpack_sorted(a), unpack(b, np.int64)).partial():
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (code, zeros, ones, weighted))),
                                                 names=["code", "zeros", "ones", "weighted"])

    sums = counts.mapInArrow(partial, "code long, zeros double, ones double, weighted double").groupBy("code").agg(
        F.sum("zeros"), F.sum("ones"), F.sum("weighted"))
    shared = counts.sparkSession.sparkContext.broadcast(top_levels(sums.collect()))  # at most 256 x 255 rows

    def finish(batches):
        for kind, bucket, a, b in _rows(batches, "kind", "bucket", "a", "b"):
            logp = Subtrees(unpack_sorted(a), unpack(b, np.int64)).log_p(shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([a], pa.binary()),
                 pa.array([pack(logp)], pa.binary())], names=["kind", "bucket", "a", "b"])

    return counts.mapInArrow(finish, "kind int, bucket int, a binary, b binary")


class Lookup:
    """Value by key for keys that are all present; open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.slots) - 1)

    def _hash(self, k: np.ndarray) -> np.ndarray:
        return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        at = self._hash(k)
        i = self.slots[at]
        wrong = np.flatnonzero(self.keys[i] != k)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            i[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[i[wrong]] != k[wrong]]
        return self.values[i]


def replies(sent: DataFrame, model: DataFrame) -> DataFrame:
    """(block, kind, a, b): every block's runs and tokens with their values from ``model``.

    The model of a bucket goes to each share of the bucket's rows and is read
    before them, so only one bucket's model and one row are in memory.
    """
    rows = sent.select("kind", "bucket", F.pmod("block", F.lit(SHARES)).cast("int").alias("share"),
                       F.lit(1).alias("turn"), "block", "a", "b").unionByName(
        model.select("kind", "bucket", F.explode(F.array(*map(F.lit, range(SHARES)))).alias("share"),
                     F.lit(0).alias("turn"), F.lit(None).cast("long").alias("block"), "a", "b"))

    def run(batches):
        find = None
        for kind, turn, block, a, b in _rows(batches, "kind", "turn", "block", "a", "b"):
            if turn == 0:
                if kind == 1:
                    keys, values = unpack_sorted(a), unpack(b, np.float32)
                    find = lambda x, k=keys, v=values: v[np.searchsorted(k, unpack_sorted(x))]
                else:
                    d = dict(zip(expand(a).split(b"\n"), unpack(b, np.int64).tolist(), strict=True))
                    find = lambda x, d=d: np.array([d[w] for w in expand(x).split(b"\n")], np.int64)
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([a], pa.binary()),
                 pa.array([pack(find(a))], pa.binary())], names=["block", "kind", "a", "b"])

    by = ["kind", "bucket", "share"]
    return rows.repartition(*by).sortWithinPartitions(*by, "turn").mapInArrow(
        run, "block long, kind int, a binary, b binary")


class BlockModel:
    """Values of one block's runs and tokens, and the scores of its texts."""

    def __init__(self, n: int, v: int, ends: int):
        self.floor, self.ends, self.n = n + 0.1 * (v + 1), ends, n
        self.end = float(np.log10((ends + 0.1) / self.floor))
        self.known = float(np.log10(0.6 / self.floor))  # between the logs of counts 0 and 1
        self.keys, self.values, self.base, self.runs = [], [], {}, None

    def add(self, kind: int, a: bytes, b: bytes) -> None:
        if kind == 1:
            self.keys.append(unpack_sorted(a))
            self.values.append(unpack(b, np.float32))
        else:
            logs = np.log10((unpack(b, np.int64) + 0.1) / self.floor)
            self.base.update(zip(expand(a).split(b"\n"), logs.tolist(), strict=True))

    def score(self, texts: list[bytes]):
        """(base score, known tokens, score, bytes) of every text."""
        if self.runs is None:
            self.runs = Lookup(np.concatenate(self.keys), np.concatenate(self.values).astype(np.float64))
            self.keys, self.values = [], []
        k, sizes = run_keys(texts)
        score = np.add.reduceat(self.runs[k], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        base, known = [], []
        for x in texts:
            p = np.array([self.base[w] for w in x.split()])
            base.append(float(p.sum()) + self.end)
            known.append(int((p > self.known).sum()) + (self.ends > 0))
        return base, known, score, sizes


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, train boolean) -> doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = docs.sparkSession
    small_batches(spark, 100)
    buckets = min(BUCKETS, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    t = blocks_of(docs, buckets, block_bytes)
    sent = t.where(F.col("kind") > 0).select("block", "kind", "bucket", "a", "b")
    part = summed(sent.withColumn("share", F.pmod("block", F.lit(SHARES))), "kind", "bucket", "share")
    counts = materialize(summed(part, "kind", "bucket"), "lm-counts")
    runs, words = counts.where(F.col("kind") == 1), counts.where(F.col("kind") == 2)

    def sizes(batches):
        for (b,) in _rows(batches, "b"):
            n = unpack(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])],
                                             names=["n", "v"])

    total = words.mapInArrow(sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).head()
    ends = t.where(F.col("kind") == 0).agg(F.sum(F.size(F.filter("train", lambda x: x)))).head()[0] or 0
    n, v = int(total[0] or 0) + ends, int(total[1] or 0) + (ends > 0)
    model = materialize(context_tree(runs), "lm-model").unionByName(words)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    none = {c: F.lit(None).cast(t.schema[c].dataType).alias(c) for c in ("ids", "train", "tokens")}
    rows = replies(sent, model).select("block", "kind", *none.values(), "a", "b").unionByName(
        t.where(F.col("kind") == 0).select("block", F.lit(9).alias("kind"), "ids", "train", "tokens", "a", "b"))

    def score(batches):
        at, m = None, None
        for b in batches:
            ids_col = b.column("ids")
            for i, (block, kind, train, tokens, a, x) in enumerate(
                    _rows([b], "block", "kind", "train", "tokens", "a", "b")):
                if block != at:
                    at, m = block, BlockModel(n, v, ends)
                if kind != 9:
                    m.add(kind, a, x)
                    continue
                texts = [y + b"\n" for y in expand(a).split(b"\n")[:-1]]
                base, known, got, size = m.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids_col[i].values, pa.array(train), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(np.full(len(texts), n, np.int64)), pa.array(base, pa.float64()), pa.array(got),
                     pa.array(size, pa.int64())],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        score, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double, n_bytes long")


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", crc_mod("doc_id", 10) != 0)
    s = score_documents(docs)
    return s.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score",
                    (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


QUERIES = {"op4_ctw": op4_ctw}
