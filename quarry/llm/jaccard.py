"""Operator 8: exact n-gram Jaccard join with a token-group matrix.

Documents link when the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more; the result is the connected component of every
document.  No link between different texts is lost.

1. Documents with equal sets are one node from the start.
2. Similar nodes are partitioned into groups: nodes that share a minimum hash
   meet one node of that bucket only, the one whose tokens are most common
   (of edited copies the least edited); checked links make clusters, and
   clusters are cut into groups of about ``GROUP`` nodes.
3. The token-group matrix holds for every group the union of its members'
   tokens: tokens hashed to columns, the largest count of any member in each.
4. A query node meets a group if they share a prefix token and their sizes
   allow a link.  Tokens are ordered from rare to frequent by a fixed-size
   sketch of their counts; any common order keeps prefixes exact, rare tokens
   first keep the meetings few.  A node meets no group of its own cluster: it
   is connected already.
5. The overlap of query and group is bounded by the matrix; only groups whose
   bound reaches the needed overlap are opened, and their members' exact sets,
   hashed again from the texts, are compared.

Shingles are compared as 64-bit hashes of word hashes.

Defined results: null, empty and word-less texts have empty sets, 0 shingles
and link with nothing, so their component is their own id; a text of one to
four words has one shingle of all its words; repeated rows have equal sets; a
row without id has the component of the documents with an equal set, or null;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, materialize, small_batches, table
from quarry.llm.graph import components

SHINGLE = 5
KEYS = 4
GROUP = 32
# Cells in each of the two rows of the count sketch, and its slices.
CELLS = 1 << 21
SLICES = 8
# Rows of (id, id) shared with every task at most; beyond it texts are shuffled.
SHARE_ROWS = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> position in ``of``, the array of 64-bit word hashes; bounded."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        self.of = np.zeros(self.LIMIT + 1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i >= self.LIMIT:
            raise OverflowError
        self.of[i] = xxhash.xxh64_intdigest(word)
        self[word] = i
        return i

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(words) <= self.LIMIT:
            try:
                return self.of[np.array([self[w] for w in words], dtype=np.int64)]
            except OverflowError:
                self.clear()
            try:
                return self.of[np.array([self[w] for w in words], dtype=np.int64)]
            except OverflowError:
                self.clear()
        return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def shingle_set(text: bytes, cache: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = cache.hashes(words)
    if len(w) < n:
        h = np.array([len(w)], dtype=np.uint64)
        for x in w:
            h = mix(h * _MULT[0] + x)
        return h
    h = w[:len(w) - n + 1] * _MULT[0]
    for i in range(1, n):
        h = h + w[i:len(w) - n + 1 + i] * _MULT[i]
    return np.unique(mix(h))


def set_id(s: np.ndarray) -> int:
    """64-bit hash of a whole set."""
    if not len(s):
        return 0
    a = np.add.reduce(mix(s ^ _MULT[1]), keepdims=True)
    b = np.bitwise_xor.reduce(mix(s ^ _MULT[2]), keepdims=True)
    return int(mix(a ^ (b * _MULT[3]) ^ np.uint64(len(s))).view(np.int64)[0])


def cells_of(s: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(cells - 1)
    return ((s >> np.uint64(20)) & m).astype(np.int64), ((s >> np.uint64(41)) & m).astype(np.int64)


def needed_overlap(a, b):
    """Least overlap of sets of sizes a and b with 100 * both >= 80 * either."""
    return -(-4 * (a + b) // 9)


def probe_length(n):
    return n - -(-4 * n // 5) + 1


def estimates(s: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    """Count of every token, never too low."""
    i, j = cells_of(s, cells)
    return np.minimum(sketch[0, i], sketch[1, j]).astype(np.float64)


def columns_of(s: np.ndarray) -> bytes:
    """Token counts by hashed column, about two tokens a column; empty if a count passes 255."""
    width = max(16, 1 << max(0, int(len(s) // 2).bit_length() - 1))
    c = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return c.astype(np.uint8).tobytes() if c.max(initial=0) <= 255 else b""


def fold(cols: np.ndarray, width: int) -> np.ndarray:
    return cols.reshape(-1, width).sum(axis=0) if len(cols) > width else cols


def overlap_bound(a: bytes, b: bytes, n: int) -> int:
    """No two sets with these columns share more tokens; ``n`` if a side has none."""
    if not a or not b:
        return n
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    w = min(len(x), len(y))
    return int(np.minimum(fold(x, w), fold(y, w)).sum())


def union_columns(all_cols: list[bytes]) -> bytes:
    """Largest count in each column over the members, at the narrowest member's width."""
    if any(not c for c in all_cols):
        return b""
    arrays = [np.frombuffer(c, np.uint8).astype(np.int64) for c in all_cols]
    w = min(map(len, arrays))
    top = np.maximum.reduce([fold(a, w) for a in arrays])
    return top.astype(np.uint8).tobytes() if top.max(initial=0) <= 255 else b""


def digest(docs: DataFrame, cells: int) -> tuple[DataFrame, np.ndarray]:
    """Per document (doc_id, sid, n, keys), and the token count sketch."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    step = cells // SLICES

    def run(batches):
        cache = WordHashes()
        total = np.zeros((2, cells), dtype=np.uint8)
        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            sid, n, keys = [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(t or b"", cache)
                sid.append(set_id(s))
                n.append(len(s))
                keys.append([int((mix(s * _MULT[k] + _MULT[k])).min().view(np.int64)) for k in range(KEYS)]
                            if len(s) else [])
                i, j = cells_of(s, cells)
                # colliding tokens of one text count once; a task's counts end
                # at 255, enough to tell rare from frequent
                total[0][i] += total[0][i] < 255
                total[1][j] += total[1][j] < 255
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sid, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "sid", "n", "keys", "slice", "blob"])
        if id_type is None:
            return
        blobs = [zlib.compress(total[:, k * step:(k + 1) * step].tobytes(), 1) for k in range(SLICES)]
        none = pa.nulls(SLICES)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, id_type), none.cast(pa.int64()), none.cast(pa.int64()),
             none.cast(pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())],
            names=["doc_id", "sid", "n", "keys", "slice", "blob"])

    rows = materialize(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, sid long, n long, keys array<long>, slice int, blob binary"), "shingles")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.uint8).astype(np.uint32)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            names=["slice", "blob"])

    parts = rows.where(F.col("slice").isNotNull()).select("slice", "blob").repartition(SLICES, "slice").mapInArrow(
        add, "slice int, blob binary").collect()  # fixed size: 8 * cells bytes
    sketch = np.zeros((2, cells), dtype=np.uint32)
    for r in parts:
        sketch[:, r["slice"] * step:(r["slice"] + 1) * step] += np.frombuffer(r["blob"], np.uint32).reshape(2, step)
    # two bytes a cell for the tasks: what is more frequent than that is last anyway
    return rows.where(F.col("slice").isNull()).drop("slice", "blob"), np.minimum(sketch, 65535).astype(np.uint16)


def prefixes(docs: DataFrame, sketch: np.ndarray, cells: int) -> DataFrame:
    """(doc_id, sid, probe, cols, common): rarest tokens, hashed columns, mean token count."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # what other tokens put into a cell: counts within three deviations of it are all rare
    noise = float(np.median(sketch))
    unit = 3 * np.sqrt(noise) + 1
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        cache = WordHashes()
        counts = shared.value
        for b in batches:
            sid, probe, cols, common = [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(t or b"", cache)
                est = estimates(s, counts, cells)
                sid.append(set_id(s))
                level = np.frexp(np.maximum(est - noise, 0) / unit)[1].clip(0)
                probe.append(s[np.lexsort((s, level))][:probe_length(len(s))].view(np.int64))
                cols.append(columns_of(s))
                common.append(float(est.mean()) if len(s) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sid, pa.int64()), pa.array(probe, pa.list_(pa.int64())),
                 pa.array(cols, pa.binary()), pa.array(common, pa.float64())],
                names=["doc_id", "sid", "probe", "cols", "common"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, sid long, probe array<long>, cols binary, common double")


def shared_if_small(df: DataFrame, rows: int = SHARE_ROWS) -> DataFrame:
    """Broadcast hint for a written table of two numbers a row, if its counted size allows."""
    return F.broadcast(df) if df.count() <= rows else df


def exact_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens binary) of the wanted nodes, hashed again from one text of each."""
    need = materialize(wanted.select("sid").distinct().join(nodes.select("sid", "rep"), "sid"), "wanted")
    need = shared_if_small(need.select(F.col("sid").alias("w_sid"), F.col("rep").alias("w_id")))
    d = docs.select("doc_id", "text").join(need, F.col("doc_id") == F.col("w_id")).select("w_sid", "text")

    def run(batches):
        cache = WordHashes()
        for b in batches:
            sid, tokens = [], []
            for k, t in zip(b.column("w_sid").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(),
                            strict=True):
                s = shingle_set(t or b"", cache)
                if set_id(s) == k:
                    sid.append(k)
                    tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(tokens, pa.binary())],
                                             names=["sid", "tokens"])

    return materialize(d.mapInArrow(run, "sid long, tokens binary").dropDuplicates(["sid"]), "sets")


def checked_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact sets reach the similarity."""
    a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    p = pairs.select("a", "b").distinct().join(b, "b").join(a, "a").select("a", "b", "ta", "tb")

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("ta").to_pylist(), t.column("tb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(m), t.column("b").filter(m)], names=["a", "b"])

    return p.mapInArrow(run, "a long, b long")


def matrix(nodes: DataFrame) -> DataFrame:
    """Token-group matrix of groups of several nodes: (g, cols)."""

    def union(t: pa.Table) -> pa.Table:
        return pa.table({"g": t.column("g")[:1],
                         "cols": pa.array([union_columns(t.column("cols").to_pylist())], pa.binary())})

    return nodes.where(F.col("size") > 1).select("g", "cols").groupBy("g").applyInArrow(union, "g long, cols binary")


def meetings(nodes: DataFrame) -> DataFrame:
    """(q, g, qn, low): queries and groups of other clusters that can still link by their prefixes.

    One table holds both sides, so that it is shuffled once: a lone node is a
    query and a group (kind 3), a node of a cluster is a query (1), the union
    of a group's prefixes is a group (2).  Sets of sizes a and b that link
    share a token within the first a - o + 1 and b - o + 1 of their orders,
    where o is the overlap they need; a token met further back does not count.
    """
    p = nodes.select("sid", "n", "cl", "g", "size", F.posexplode("probe").alias("at", "token"))
    sides = p.select("token", F.col("sid").alias("id"), "cl", F.col("n").alias("low"), F.col("n").alias("high"), "at",
                     F.when(F.col("size") > 1, 1).otherwise(3).alias("kind")).unionByName(
        p.where(F.col("size") > 1).groupBy("token", "g").agg(
            F.first("cl").alias("cl"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("at").alias("at")).select(
            "token", F.col("g").alias("id"), "cl", "low", "high", "at", F.lit(2).alias("kind")))
    # the query's own size is low and high alike; the least overlap goes with the
    # group's smallest member that can link, the longest prefix with its largest
    q_need = F.ceil(4 * (F.col("q.low") + F.greatest("g.low", F.ceil(4 * F.col("q.high") / 5))) / 9)
    g_need = F.ceil(4 * (F.col("q.low") + F.col("g.high")) / 9)
    m = sides.alias("q").join(sides.alias("g"), "token").where(
        (F.col("q.kind") * 4 + F.col("g.kind")).isin(6, 7, 14, 15) & (F.col("q.cl") != F.col("g.cl"))
        & (F.col("q.low") >= F.col("g.low")) & (5 * F.col("g.high") >= 4 * F.col("q.high"))
        & (F.col("q.at") + q_need <= F.col("q.high")) & (F.col("g.at") + g_need <= F.col("g.high")))
    return m.groupBy(F.col("q.id").alias("q"), F.col("g.id").alias("g"), F.col("q.high").alias("qn"),
                     F.col("g.low").alias("low")).agg(F.count(F.lit(1)).alias("shared")).drop("shared")


def qualifying(met: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The meetings (q, g) whose overlap bound reaches what a link needs."""
    q = nodes.select(F.col("sid").alias("q"), F.col("cols").alias("qc"))
    g = nodes.where(F.col("size") == 1).select("g", F.col("cols").alias("gc")).unionByName(
        groups.select("g", F.col("cols").alias("gc")))
    p = met.join(q, "q").join(g, "g").select("q", "g", "qn", "qc", "gc", "low")

    def run(batches):
        for t in batches:
            keep = [overlap_bound(x, y, n) >= max(-(-4 * n // 5), needed_overlap(n, low))
                    for x, y, n, low in zip(t.column("qc").to_pylist(), t.column("gc").to_pylist(),
                                            t.column("qn").to_pylist(), t.column("low").to_pylist(), strict=True)]
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("q").filter(m), t.column("g").filter(m)], names=["q", "g"])

    return p.mapInArrow(run, "q long, g long")


def jaccard_components(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, n_shingles, component_id of (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    seen, sketch = digest(docs, cells)
    first_of = seen.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys")).withColumnRenamed(
        "sid", "n_sid")
    nodes = prefixes(docs, sketch, cells).join(
        first_of, (F.col("sid") == F.col("n_sid")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["sid"])
    nodes = materialize(nodes.select("sid", "rep", "n", "keys", "common", "probe", "cols"), "nodes")

    # groups: a node meets the most common node of each of its minimum-hash buckets
    keyed = nodes.select("sid", "n", "common", F.posexplode("keys").alias("k", "key"))
    center = keyed.groupBy("k", "key").agg(
        F.max(F.struct("common", "sid", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where(
        F.col("m") > 1).select("k", "key", F.col("c.sid").alias("b"), F.col("c.n").alias("bn"))
    near = keyed.join(center, ["k", "key"]).where(
        (F.col("sid") != F.col("b")) & (5 * F.least("n", "bn") >= 4 * F.greatest("n", "bn"))).select(
        F.col("sid").alias("a"), "b").distinct()
    near = materialize(near, "near")
    sets = exact_sets(docs, nodes, near.select(F.col("a").alias("sid")).unionByName(
        near.select(F.col("b").alias("sid"))))
    first = materialize(checked_links(near, sets), "links-1")
    cluster = components(first).select(F.col("node").alias("c_sid"), F.col("root"))
    size = cluster.groupBy("root").agg(F.count(F.lit(1)).alias("size")).select(F.col("root").alias("r"), "size")
    cluster = materialize(cluster.join(size, F.col("root") == F.col("r")).drop("r"), "clusters")
    nodes = (nodes.join(shared_if_small(cluster), F.col("sid") == F.col("c_sid"), "left")
             .withColumn("cl", F.coalesce("root", "sid")).withColumn("size", F.coalesce("size", F.lit(1)))
             .withColumn("g", F.when(F.col("size") == 1, F.col("sid")).otherwise(F.xxhash64(
                 "cl", F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / GROUP)))))
             .select("sid", "rep", "n", "probe", "cols", "cl", "size", "g"))
    groups = materialize(matrix(nodes), "matrix")

    # groups that can hold a partner of a query are opened, their members compared
    met = meetings(nodes)
    opened = materialize(qualifying(met, nodes, groups), "opened")
    members = nodes.select(F.col("sid").alias("b"), "g", F.col("n").alias("bn"))
    q_size = nodes.select(F.col("sid").alias("q"), F.col("n").alias("qn"))
    pairs = (opened.join(members, "g").join(q_size, "q")
             .where(5 * F.least("qn", "bn") >= 4 * F.greatest("qn", "bn"))
             .select(F.greatest("q", "b").alias("a"), F.least("q", "b").alias("b")).distinct())
    pairs = materialize(pairs, "pairs")
    sets = exact_sets(docs, nodes, pairs.select(F.col("a").alias("sid")).unionByName(
        pairs.select(F.col("b").alias("sid"))))
    second = checked_links(pairs, sets)

    root = components(first.unionByName(second)).select(F.col("node").alias("n_sid"), "root")
    named = nodes.select("sid", "rep").join(root, F.col("sid") == F.col("n_sid"), "left").withColumn(
        "root", F.coalesce("root", "sid"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id")).select(
        F.col("root").alias("r"), "component_id")
    named = named.join(lowest, F.col("root") == F.col("r")).select(F.col("sid").alias("x_sid"), "component_id")
    filled = seen.where(F.col("n") > 0).join(named, F.col("sid") == F.col("x_sid"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = seen.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"),
                                               F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component (the smallest id), all columns kept.

    Documents without words and rows without id stay; of several rows with one
    id and one text one stays.
    """
    name = fresh(docs, "id")
    c = materialize(jaccard_components(docs).where(F.col("n_shingles") > 0), "components")
    lost = c.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    lost = shared_if_small(materialize(lost, "lost"))
    again = c.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where(
        F.col("m") > 1).select(F.col("doc_id").alias(name))
    again = shared_if_small(materialize(again, "again"))
    kept = docs.join(lost, F.col("doc_id") == F.col(name), "left_anti")
    once = kept.join(again, F.col("doc_id") == F.col(name), "left_anti")
    more = kept.join(again, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard": op8_jaccard}
