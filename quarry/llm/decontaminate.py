"""Operator 3: benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of ten consecutive
words (an item of fewer words is one window).  The windows become one
Aho-Corasick automaton over word numbers; every document's words pass through
it once.  Word positions are mapped back to code-point offsets of the original
text for the documents that were hit.

Items are shared with the tasks in blocks of at most ``BLOCK_WORDS`` words
(measured, not assumed): a benchmark within the bound is one automaton and one
pass; a larger one takes one pass per block, each adding its hits to those of
the passes before.

Defined results: null and word-less texts have no words and no hits; an item
without words matches nothing; a null item id counts as the empty string;
several rows of one item id are one item with the windows of all; repeated
documents give repeated rows; empty tables give no hits or no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, materialize, small_batches, table

WINDOW = 10
BLOCK_WORDS = 100_000
BUCKETS = 16

# every ASCII byte that is not a digit or a letter separates words; A-Z are lower-cased
_NORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
              for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HIT_TYPE = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW_HIT = pa.struct([
    ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()),
                                 ("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORM).split()


def window_list(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words_of((text or "").encode("utf-8", "surrogatepass"))
    if not w:
        return []
    n = min(window, len(w))
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def item_blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """Items as (item_id, text) in blocks of at most ``block_words`` words each.

    Equal rows count once.  Rows are dealt to buckets by a hash, about
    ``BUCKETS`` to a block; a block is a run of buckets within the bound, or one
    bucket (an item is never cut).  Nothing of the texts is collected here.
    """
    n = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                     F.coalesce(F.col("text"), F.lit("")).alias("text"), n.cast("long").alias("n"))
    total = d.agg(F.sum("n")).head()[0] or 0
    if total <= block_words:
        return [d.select("item_id", "text")] if total else []
    buckets = BUCKETS * -(-total // block_words)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets))
    d = materialize(d.distinct().withColumn("bucket", bucket), "decon-items")
    runs: list[list[int]] = []  # first and last bucket, words
    for k, words in d.groupBy("bucket").agg(F.sum("n")).orderBy("bucket").collect():
        if runs and runs[-1][2] + words <= block_words:
            runs[-1][1:] = [k, runs[-1][2] + words]
        else:
            runs.append([k, k, words])
    return [d.where(F.col("bucket").between(x, y)).select("item_id", "text") for x, y, _ in runs]


def build(items: list[tuple[str, str]], window: int):
    """(word numbers, automaton) of a block; the automaton's values are (length, item ids)."""
    import ahocorasick
    vocab: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        for win in window_list(text, window):
            key = tuple(vocab.setdefault(w, len(vocab) + 1) for w in win)
            owners.setdefault(key, set()).add(item_id)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, who in owners.items():
        auto.add_word(key, (len(key), tuple(sorted(who))))
    if owners:
        auto.make_automaton()
    return vocab, (auto if owners else None)


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed word ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def hit_of(text: bytes, vocab, auto, before: dict | None) -> dict:
    words = words_of(text)
    runs = [(r["first"], r["last"]) for r in before["runs"]] if before else []
    items = set(before["items"]) if before else set()
    known = len(runs)
    if auto is not None and words:
        get = vocab.get
        for end, (n, who) in auto.iter(tuple([get(w, 0) for w in words])):
            if runs and len(runs) > known and end - n + 1 <= runs[-1][1] + 1 and runs[-1][0] <= end - n + 1:
                runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
            else:
                runs.append((end - n + 1, end))
            items.update(who)
    if not runs:
        return {"n_words": len(words), "runs": [], "items": []}
    at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "surrogatepass"))]
    return {"n_words": len(words), "items": sorted(items),
            "runs": [{"first": a, "last": b, "start": at[a][0], "end": at[b][1]}
                     for a, b in merge_runs(runs)]}


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
         block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (its ``keep`` columns) with one more struct column, and that column's name.

    The struct has n_words, runs (word ranges first..last, and start/end
    code-point offsets in the original text) and items (sorted item ids).
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = docs.columns if keep is None else keep
    hit = fresh(docs, "hit")
    blocks = item_blocks(items, block_words) or [None]
    df = docs
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        # one block at a time is on the driver
        shared = spark.sparkContext.broadcast(
            {"items": [] if block is None else [(r[0], r[1]) for r in block.collect()]})
        names = keep if last else list(dict.fromkeys([*keep, text_col]))

        def run(batches, shared=shared, names=names):
            b = shared.value
            if "auto" not in b:  # built once for a worker process
                b["auto"] = build(b["items"], window)
            vocab, auto = b["auto"]
            for batch in batches:
                texts = batch.column(text_col).cast(pa.binary()).to_pylist()
                before = batch.column(hit).to_pylist() if hit in batch.schema.names else [None] * len(texts)
                out = pa.array([hit_of(t or b"", vocab, auto, p) for t, p in zip(texts, before, strict=True)],
                               type=_ARROW_HIT)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [out], names=[*names, hit])

        fields = [docs.schema[c] for c in names]
        need = list(dict.fromkeys([*names, text_col] + ([hit] if i else [])))
        df = df.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(
            run, T.StructType([*fields, T.StructField(hit, HIT_TYPE)]))
        if not last:
            df = materialize(df, "decon-pass")
            shared.destroy()
    return df, hit


def contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated."""
    df, hit = scan(docs.select("doc_id", "text"), items, keep=["doc_id"], **kw)
    h = F.col(hit)
    n_hit = F.aggregate(h["runs"], F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return df.select(
        "doc_id", h["n_words"].alias("n_words"), n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"), h["items"].alias("item_ids"),
        F.transform(h["runs"], lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
        (F.size(h["runs"]) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    df, hit = scan(docs, items, **kw)
    return df.where(F.size(F.col(hit)["runs"]) == 0).drop(hit)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
                    "contaminated")


QUERIES = {"op3_decontamination": op3_decontamination}

ORACLES = {"op3_decontamination": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, d.n, win FROM (
    SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, lens WHERE len(w) >= n) d
  JOIN (SELECT DISTINCT n, win FROM win) x
    ON d.n = x.n AND array_to_string(d.w[d.i:d.i + d.n - 1], ' ') = x.win),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM occ JOIN win USING (n, win)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""}
