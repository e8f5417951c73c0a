"""Operator 11: approximate nearest neighbours by an adaptive dimension scan.

An inverted-list index: spherical k-means on a bounded sample gives list
centres, and every vector is stored in the list of its nearest centre.  Lists
are cut into cells of bounded size; a cell keeps its vectors rotated (random
signs and a Walsh-Hadamard transform, three times) in blocks of columns.  A
query visits the cells of the lists it probes and adds up partial distances
block by block.  After each block a hypothesis test compares the distance
estimated from the dimensions seen so far with the bound that the query's k-th
best known inner product sets, and abandons a candidate that is too far.  What
is left is scored on the original vectors, in double precision, summed from
the first component to the last.

The measure is the inner product.  For vectors q, x the bound t on it is the
bound |q|^2 + |x|^2 - 2t on the squared distance, which rotation leaves alone.
A query's first bound is its k-th best among a part of the sample (a 16th of
the vectors at most), whose vectors are candidates themselves, so it never
excludes a true neighbour.  A query left with fewer than k rows although there
are more goes through all lists once more, without a bound.

How many lists a query probes is measured: a hashed sample of at most about
``GAUGE`` queries is answered by brute force over all vectors, and the number
of probes is the smallest that reaches ``REACH`` of those neighbours.

Equal vectors are one class with its k + 1 smallest ids; no result needs more
of them.  So a vector on a third of all rows is one candidate and one search,
and its copies are merged per batch, then salted, before they meet.

Bounds: the index is fitted on about ``FIT_BYTES`` of hashed sample, which also
bounds the centres shared with every task (the square root of the vectors, at
most one per 16 sampled vectors, and 64 vectors each at least); every vector is
indexed, and longer lists have more cells.

Defined results: null, empty or zero vectors and those with null or non-finite
components take no part, as query or candidate.  A shorter vector reads as if
padded with zeros.  A null id is a candidate (last among ties) but no
query; an id of 2^63 - 1 is read as null.  Repeated rows are candidates each; a
repeated query id is answered once a row, leaving out one row of that id.  Ties
go to the smaller id.  Very long vectors are scanned in the same blocks.  An empty table, or one
without queries, gives no rows.  Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table
from quarry.llm.neardup_vectors import rotate

K = 20
EVERY = 20          # rows whose id this divides are queries
CELL = 512          # vectors of a cell, about
COLUMNS = 16        # of a column block
EPSILON = 2.1       # of the hypothesis test
FIT_BYTES = 32 << 20
FIRST = 4096        # sampled vectors that give a query's first bound
GAUGE = 128
REACH = 0.96
ROUNDS = 6          # of k-means
SEED = 11
NO_ID = (1 << 63) - 1


def usable(v) -> bytes | None:
    """The vector as doubles; None where it takes no part."""
    if not v:
        return None
    x = np.array(v, dtype=np.float64) + 0.0  # a null component reads as NaN, -0.0 as 0.0
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def parsed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v binary) of the vectors that take part."""

    def run(batches):
        for b in batches:
            col = b.column("embedding")
            if col.null_count == 0 and len(col) and not col.flatten().null_count:
                flat, ends = col.flatten().to_numpy().astype(np.float64), col.offsets.to_numpy() - col.offsets[0].as_py()
                v = [usable(flat[i:j].tolist()) if i == j else _bytes(flat[i:j]) for i, j in zip(ends, ends[1:])]
            else:
                v = [usable(x) for x in col.to_pylist()]
            ok = np.array([x is not None for x in v], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").cast(pa.int64()).filter(pa.array(ok)), pa.array([x for x in v if x is not None], pa.binary())],
                names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, v binary")


def _bytes(x: np.ndarray) -> bytes | None:
    x = x + 0.0
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x = np.frombuffer(r)
        out[i, :len(x)] = x
    return out


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every distinct vector with its ``keep`` smallest ids, nulls last."""

    def run(batches):
        for b in batches:
            by: dict[bytes, list[int]] = {}
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
                by.setdefault(v, []).append(NO_ID if i is None else i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(by), pa.binary()), pa.array([sorted(x)[:keep] for x in by.values()], pa.list_(pa.int64()))],
                names=["v", "ids"])

    lowest = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")
    some = rows.mapInArrow(run, "v binary, ids array<long>")
    some = some.groupBy("v", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(32)).alias("salt")).agg(lowest)
    return some.groupBy("v").agg(lowest)


def hashed_share(df: DataFrame, share: float) -> DataFrame:
    """The rows whose hash of ``v`` lies in the lowest ``share`` of the hash's range."""
    if share >= 1:
        return df
    return df.where(F.xxhash64("v") < F.lit(int(-(1 << 63) + share * (1 << 64))))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def centres(sample: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: ``lists`` unit centres."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(ROUNDS):
        at = np.concatenate([np.argmax(x[i:i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where((np.abs(total).sum(axis=1) > 0)[:, None], unit(total), c)
    return c


def deal(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of about ``room`` vectors: the first cell and the number of cells of every list.

    Neighbouring small lists share a cell, a large list has several.
    """
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    cell, used = 0, 0
    for i, n in enumerate(sizes):
        if used and used + n > room:
            cell, used = cell + 1, 0
        first[i] = cell
        parts[i] = max(1, -(-int(n) // room))
        if parts[i] > 1:
            cell, used = cell + int(parts[i]), 0
        else:
            used += int(n)
    return first, parts


class Index:
    """What every task gets: centres, the greatest length in each list, cells, probes, first bounds."""

    def __init__(self, width: int, centre: np.ndarray):
        self.width, self.centre = width, centre
        n = len(centre)
        self.longest, self.rows = np.ones(n), np.zeros(n, np.int64)
        self.first, self.parts = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.probes, self.seeds = n, np.zeros((0, width))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(unit(x) @ self.centre.T, axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by the inner product with their centre at the list's greatest length, best first."""
        return np.argsort(-(unit(q) @ self.centre.T) * self.longest, axis=1, kind="stable")

    def rotated(self, x: np.ndarray) -> np.ndarray:
        pad = np.zeros((len(x), 1 << max(1, int(self.width - 1).bit_length())))
        pad[:, :self.width] = x
        return rotate(pad, SEED)

    def first_bound(self, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best inner product among the seeds, which are candidates themselves."""
        if len(self.seeds) < k:
            return np.full(len(q), -np.inf)
        return np.concatenate([-np.partition(-(q[i:i + 256] @ self.seeds.T), k - 1, axis=1)[:, k - 1]
                               for i in range(0, len(q), 256)])


def scan(qr: np.ndarray, blocks: list[np.ndarray], alive: np.ndarray, x2: np.ndarray, bound: np.ndarray,
         epsilon: float = EPSILON) -> tuple[np.ndarray, int]:
    """The adaptive dimension scan of one cell: candidates still alive for each query, and partial products made.

    ``bound`` holds every query's least inner product; ``blocks`` the cell's
    rotated columns.  A candidate is abandoned once the distance estimated
    from the columns so far is above its bound by more than the test allows.
    """
    q2 = (qr * qr).sum(axis=1)
    far = q2[:, None] + x2[None, :] - 2 * bound[:, None]
    slack = 1e-9 * (q2[:, None] + x2[None, :])
    alive = alive & (far >= -slack)
    part, seen, made, total = np.zeros(alive.shape), 0, 0, sum(b.shape[1] for b in blocks)
    for b in blocks:
        w = b.shape[1]
        q = qr[:, seen:seen + w]
        n = int(alive.sum())
        if not n:
            break
        if 8 * n > alive.size:  # many left: all pairs at once
            part += (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (q @ b.T)
            made += alive.size * w
        else:
            i, j = np.nonzero(alive)
            d = q[i] - b[j]
            part[i, j] += (d * d).sum(axis=1)
            made += n * w
        seen += w
        if seen < total:
            alive &= part * (total / seen) <= far * (1 + epsilon / np.sqrt(seen)) ** 2 + slack
        else:
            alive &= part <= far + slack
    return alive, made


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows in pairs, summed from the first component to the last."""
    out = np.zeros(len(q))
    for c in range(q.shape[1]):
        out += q[:, c] * x[:, c]
    return out


HITS = "array<struct<neg:double,id:long>>"
HIT = pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())]))


def hit_lists(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array]:
    """The queries that have hits, and each one's k best: score descending, then id."""
    by = np.lexsort((ids, -score, query))
    query, score, ids = query[by], score[by], ids[by]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    top = rank < k
    query, score, ids = query[top], score[top], ids[top]
    names, n = np.unique(query, return_counts=True)
    items = pa.StructArray.from_arrays([pa.array(0.0 - score), pa.array(ids, pa.int64())], names=["neg", "id"])
    return names, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), items)


def merged(hits: DataFrame, by: str, k: int) -> DataFrame:
    """The k best hits of each query out of its lists of hits."""
    best = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    some = hits.groupBy(by, F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(best)
    return some.groupBy(by).agg(best)


def gauge(assigned: DataFrame, asked: np.ndarray, index: Index, k: int) -> int:
    """Probes that reach ``REACH`` of the true neighbours of the asked vectors, by brute force over all vectors."""
    if not len(asked):
        return 1
    width = index.width

    def run(batches):
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for b in batches:
            x, at = matrix(b.column("v").to_pylist(), width), b.column("l").to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 2048):
                s = asked @ x[i:i + 2048].T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                for j in range(len(asked)):
                    sj, lj = np.r_[best[j][0], s[j, top[j]]], np.r_[best[j][1], at[i:i + 2048][top[j]]]
                    o = np.argsort(-sj, kind="stable")[:k]
                    best[j] = sj[o], lj[o]
        q = np.repeat(np.arange(len(asked)), [len(x[0]) for x in best])
        names, lists = hit_lists(q, np.concatenate([x[0] for x in best]), np.concatenate([x[1] for x in best]), k)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), lists], names=["q", "hits"])

    found = merged(assigned.select("v", "l").mapInArrow(run, f"q long, hits {HITS}"), "q", k).collect()
    place = np.argsort(index.order(asked), axis=1)
    ranks = np.sort([place[r["q"], h["id"]] for r in found for h in r["hits"]])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(REACH * len(ranks))))]) + 1


def packed_cells(assigned: DataFrame, share, width: int) -> DataFrame:
    """One row a cell: vectors, their lists and ids, and the rotated vectors in blocks of columns."""

    def place(batches):
        ix = share.value
        for b in batches:
            at = b.column("l").to_numpy(zero_copy_only=False)
            part = b.column("h").to_numpy(zero_copy_only=False) % ix.parts[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("v", "ids", "l")), pa.array(ix.first[at] + part)],
                                             names=["v", "ids", "l", "cell"])

    def pack(t: pa.Table) -> pa.Table:
        ix = share.value
        x, ids = matrix(t.column("v").to_pylist(), width), t.column("ids").to_pylist()
        r = ix.rotated(x)
        blocks = [np.ascontiguousarray(r[:, i:i + COLUMNS]).tobytes() for i in range(0, r.shape[1], COLUMNS)]
        out = {"cell": t.column("cell")[:1], "x": pa.array([x.tobytes()]),
               "l": pa.array([t.column("l").to_numpy().astype(np.int64).tobytes()]),
               "n_ids": pa.array([np.array([len(i) for i in ids], np.int64).tobytes()]),
               "ids": pa.array([np.array([i for some in ids for i in some], np.int64).tobytes()]),
               "blocks": pa.array([blocks], pa.list_(pa.binary()))}
        return pa.table(out)

    placed = assigned.select("v", "ids", "l", F.pmod(F.xxhash64("v"), F.lit(1 << 40)).alias("h")).mapInArrow(
        place, "v binary, ids array<long>, l int, cell long")
    return placed.groupBy("cell").applyInArrow(
        pack, "cell long, x binary, l binary, n_ids binary, ids binary, blocks array<binary>")


def probed(asks: DataFrame, share, width: int, k: int) -> DataFrame:
    """One row a cell and batch of queries: the queries, their bounds and the lists that each probes there."""

    def run(batches):
        ix = share.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("v").to_pylist(), width)
            bound = ix.first_bound(q, k)
            order = ix.order(q)
            # as many lists as gauged, and as many as it takes to meet k rows
            need = np.maximum(ix.probes, 1 + (np.cumsum(ix.rows[order], axis=1) < k).sum(axis=1))
            i, r = np.nonzero(np.arange(order.shape[1])[None, :] < need[:, None])
            at = order[i, r]
            n = ix.parts[at]
            i, at = np.repeat(i, n), np.repeat(at, n)
            cell = ix.first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            by = np.argsort(cell, kind="stable")
            i, at, cell = i[by], at[by], cell[by]
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for lo, hi in zip(cuts, cuts[1:]):
                own, qi = np.unique(i[lo:hi], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(cell[lo])], pa.int64()), pa.array([q[own].tobytes()]), pa.array([bound[own].tobytes()]),
                     pa.array([qi.astype(np.int64).tobytes()]), pa.array([at[lo:hi].astype(np.int64).tobytes()])],
                    names=["cell", "q", "bound", "who", "what"])

    return asks.select("v").mapInArrow(run, "cell long, q binary, bound binary, who binary, what binary")


def search_cells(cells: DataFrame, blocks: DataFrame, share, width: int, k: int) -> DataFrame:
    """(v, hits): of every query in every cell that it visits, its k best rows."""

    def run(batches):
        ix = share.value
        for b in batches:
            for r in b.to_pylist():
                q, x = (np.frombuffer(r[c]).reshape(-1, width) for c in ("q", "x"))
                lists, bound = np.frombuffer(r["l"], np.int64), np.frombuffer(r["bound"])
                who, what = np.frombuffer(r["who"], np.int64), np.frombuffer(r["what"], np.int64)
                low = lists.min()
                wants = np.zeros((len(q), max(lists.max(), what.max()) - min(low, what.min()) + 1), bool)
                base = min(low, what.min())
                wants[who, what - base] = True
                parts = [np.frombuffer(c).reshape(len(x), -1) for c in r["blocks"]]
                alive, _ = scan(ix.rotated(q), parts, wants[:, lists - base], (x * x).sum(axis=1), bound)
                i, j = np.nonzero(alive)
                s = products(q[i], x[j])
                n, ids = np.frombuffer(r["n_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                start = np.cumsum(n) - n
                many = n[j]
                row = np.repeat(start[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                names, hits = hit_lists(np.repeat(i, many), np.repeat(s, many), ids[row], k)
                if len(names):
                    # a query is named by its vector, without the padding
                    yield pa.RecordBatch.from_arrays([pa.array([q[a].tobytes() for a in names], pa.binary()), hits],
                                                     names=["v", "hits"])

    # a few queries make a row in every cell they visit, which Spark takes for a handful: neither side is sent to the driver
    return blocks.join(cells.hint("merge"), "cell").mapInArrow(run, f"v binary, hits {HITS}")


def padded(width: int):
    """A query's name in the cells: its vector with zeros up to the full width."""
    return F.rpad("v", 8 * width, F.lit(b"\x00"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, embedding) of candidates and queries -> query_id, rank, vec_id, score.

    A query leaves out one candidate row of its own id and vector.
    """
    spark = vectors.sparkSession
    keep = k + 1  # the query's own row is among its hits
    cls = materialize(classes(parsed(vectors), keep), "ann-classes")
    asks = materialize(parsed(queries.where(F.col("vec_id").isNotNull())), "ann-asks")
    empty = "query_id long, rank int, vec_id long, score double"
    n, width = cls.agg(F.count(F.lit(1)), F.max(F.length("v"))).head()
    asked = asks.agg(F.max(F.length("v"))).head()[0]
    if not n or not asked:
        return spark.createDataFrame([], empty)
    width = max(width, asked) // 8
    room = max(16, FIT_BYTES // (8 * width))
    sample = matrix([r["v"] for r in hashed_share(cls.select("v"), room / n).collect()], width)
    if not len(sample):
        sample = matrix([r["v"] for r in cls.select("v").limit(16).collect()], width)
    lists = max(1, min(int(np.sqrt(n)), n // 64, min(room, len(sample)) // 16))
    index = Index(width, centres(sample, lists))
    index.seeds = sample[:min(FIRST, n // 16)]
    share = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width)
            at = share.value.nearest(x) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column("v"), b.column("ids"), pa.array(at, pa.int32()), pa.array(np.sqrt((x * x).sum(axis=1)))],
                names=["v", "ids", "l", "length"])

    assigned = materialize(cls.mapInArrow(assign, "v binary, ids array<long>, l int, length double"), "ann-lists")
    sizes = np.zeros(lists, np.int64)
    for r in assigned.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("rows"),
                                       F.max("length").alias("longest")).collect():  # a row a list
        sizes[r["l"]], index.rows[r["l"]], index.longest[r["l"]] = r["n"], r["rows"], r["longest"]
    index.first, index.parts = deal(sizes, CELL)
    distinct = materialize(asks.select("v").distinct(), "ann-queries")
    some = hashed_share(distinct, GAUGE / distinct.count()).limit(2 * GAUGE).collect() or distinct.limit(1).collect()
    index.probes = min(lists, gauge(assigned, matrix([r["v"] for r in some], width), index, keep))
    full = spark.sparkContext.broadcast(index)
    cells = materialize(packed_cells(assigned, full, width), "ann-cells")
    found = materialize(merged(search_cells(cells, probed(distinct, full, width, keep), full, width, keep), "v", keep),
                        "ann-found").withColumnRenamed("v", "u")
    complete = found.where(F.size("hits") >= min(keep, int(index.rows.sum())))
    short = distinct.join(complete, padded(width) == F.col("u"), "left_anti")
    if short.limit(1).count():
        index.probes, index.seeds = lists, index.seeds[:0]
        whole = spark.sparkContext.broadcast(index)
        more = merged(search_cells(cells, probed(short, whole, width, keep), whole, width, keep), "v", keep)
        found = complete.unionByName(materialize(more, "ann-more").withColumnRenamed("v", "u"))
    at = F.array_position(F.transform("hits", lambda h: h["id"]), F.col("query_id"))
    others = F.when(F.col("at") > 0, F.concat(F.slice("hits", 1, F.col("at").cast("int") - 1),
                                              F.slice("hits", F.col("at").cast("int") + 1, F.lit(keep)))).otherwise(F.col("hits"))
    out = (asks.join(found, padded(width) == F.col("u")).select(F.col("vec_id").alias("query_id"), "hits")
           .withColumn("at", at).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "hit")))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                      F.nullif(F.col("hit.id"), F.lit(NO_ID)).alias("vec_id"), (F.lit(0.0) - F.col("hit.neg")).alias("score"))


def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op11_ann": op11_ann}
