"""Operator 7: secret scan by corpus-wide ownership frequency.

Candidates are found with regular expressions in whole texts.  Each candidate
value is hashed; over the corpus its distinct repositories (texts, so copies of
a document are one) and owners (sources) are counted.  A value held by more
than ``MAX_OWNERS`` owners is a widely copied example; one of fewer owners is
theirs, in however many repositories, and counts as live.  Live values that the
base patterns do not name are added as spans of kind ``owner``: bare tokens of
20 or more characters that mix letters and digits and look random, changing
between digits, small and capital letters once in four characters at least.

All DataFrame operations.  Counting first makes (value, owner, repository)
distinct, so a value held by a third of the corpus is combined before it
meets; only live values are joined back, by a join that Spark may split.

Defined results: null text is empty; a null source is an owner of its own;
repeated rows count as one repository; very long texts are scanned whole; ties
of spans go by kind as listed; other columns are not read; a row without candidates has zero
counts and the hash of the empty string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table

# kind -> (pattern, group holding the value, least length of that group)
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9_-]{20,}"
# a value held by more owners than this is a copied example
MAX_OWNERS = 2
# characters for each run of one class (digits, small, capital letters) at most
RUN = 4

SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
PLACED = "array<struct<at:bigint,c:array<struct<m:string,g:string>>>>"


# Matches of a text that are walked together: arrays grow by appending within
# a chunk and by chunks, so the work follows the number of matches.
CHUNK = 128


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost and non-overlapping, as (start, end, kind, match)."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(match.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)).alias("g"))
    # a lambda's variable is computed once, an expression inside a lambda once an element
    chunks = F.get(F.transform(F.array(pairs), lambda a: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")),
        lambda i: F.slice(a, i * CHUNK + 1, CHUNK))), F.lit(0))
    zero, ends = F.lit(0).cast("long"), lambda at, x: (at + F.length(x["g"]) + F.length(x["m"])).cast("long")
    placed = F.aggregate(
        chunks, F.struct(zero.alias("at"), F.array().cast(PLACED).alias("out")),
        lambda a, c: F.struct(
            F.aggregate(c, a["at"], ends).alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("at"), c.alias("c"))).alias("out")),
        lambda a: a["out"])
    walk = F.flatten(F.transform(placed, lambda p: F.aggregate(
        p["c"], F.struct(p["at"].alias("at"), F.array().cast(SPANS).alias("out")),
        lambda a, x: F.struct(
            ends(a["at"], x).alias("at"),
            F.array_append(a["out"], F.struct(
                (a["at"] + F.length(x["g"])).cast("long").alias("start"), ends(a["at"], x).alias("end"),
                F.lit(kind).alias("kind"), x["m"].alias("value"))).alias("out")),
        lambda a: a["out"])))
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(SPANS))


def candidates(text: Column) -> dict[str, Column]:
    """Base spans by kind, with the secret's value; failing matches are dropped."""
    assign = F.transform(spans_of(text, ASSIGN, "assign"), lambda s: F.struct(
        s["start"], s["end"], s["kind"],
        F.regexp_extract(s["value"], ASSIGN, 2).alias("value")))
    return {
        "assign": F.filter(assign, lambda s: F.length(s["value"]) >= 12),
        "access": F.filter(spans_of(text, ACCESS, "access"), lambda s: F.length(s["value"]) >= 18),
        "hex": spans_of(text, HEX, "hex"),
        "bare": F.filter(spans_of(text, BARE, "owner"), lambda s: (
            s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (RUN * runs(s["value"]) >= F.length(s["value"])))),
    }


def runs(value: Column) -> Column:
    """Number of runs of digits, of small and of capital letters."""
    for run, one in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[_-]", "")):
        value = F.regexp_replace(value, run, one)
    return F.length(value)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda s: (F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1)
                      .when(s["kind"] == "hex", 2).otherwise(3))
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.concat_ws(",", F.transform(F.sort_array(keyed), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def ownership(seen: DataFrame) -> DataFrame:
    """(h, source, text_hash) -> h, n_owners, n_repos: a value's distinct owners and distinct repositories of theirs."""
    held = seen.select("h", "source", "text_hash").distinct()
    per_owner = held.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("h").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def beside_base(seen: DataFrame) -> DataFrame:
    """``seen`` without added spans that overlap a base span of their text: two sorted passes over the spans of a text."""
    text = Window.partitionBy("doc_id", "text_hash")
    is_base = F.col("kind") != "owner"
    # both frames grow with the sort; ties of a start are in both
    before = F.max(F.when(is_base, F.col("end"))).over(text.orderBy("start"))
    after = F.min(F.when(is_base, F.col("start"))).over(text.orderBy(F.col("start").desc()))
    apart = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return seen.withColumn("apart", is_base | apart).where("apart").drop("apart")


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row of (doc_id, text, source): counts, base spans, live values and added spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "source", text.alias("text"), F.xxhash64(F.col("text")).alias("text_hash"))
    c = candidates(F.col("text"))
    d = d.select("doc_id", "source", "text_hash", *[v.alias(k) for k, v in c.items()])
    d = materialize(d, "secret-spans")
    base = F.concat("assign", "access", "hex")
    seen = (d.where(F.size("assign") + F.size("access") + F.size("hex") + F.size("bare") > 0)
            .select("doc_id", "source", "text_hash", F.explode(F.concat(base, "bare")).alias("s"))
            .select("doc_id", "source", "text_hash", "s.start", "s.end", "s.kind",
                    F.sha2(F.col("s.value").cast("binary"), 256).alias("h")))
    seen = beside_base(seen)
    live = ownership(seen).where(F.col("n_owners") <= max_owners).select("h")
    found = (seen.join(live, "h").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "end", "kind")).alias("live")))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "live")
    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    out = (d.select("doc_id", "text_hash", "source",
                    F.size("assign").cast("long").alias("n_assign"),
                    F.size("access").cast("long").alias("n_access"),
                    F.size("hex").cast("long").alias("n_hex"), base.alias("base"))
           .join(found, F.col("doc_id").eqNullSafe(F.col("f_id"))
                 & F.col("text_hash").eqNullSafe(F.col("f_hash")), "left")
           .withColumn("live", F.coalesce("live", F.array().cast(spans))))
    plain = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    added = F.filter("live", lambda s: s["kind"] == "owner")
    return out.select("doc_id", "source", "n_assign", "n_access", "n_hex", plain.alias("base"),
                      added.alias("added"), F.size("live").cast("long").alias("n_live"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex",
                    F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    joined(F.concat("base", "added")).alias("spans"), "n_live")


QUERIES = {"op7_secrets": op7_secrets}

_FOUND_SQL = " UNION ALL ".join(
    f"SELECT r, doc_id, source, t, '{kind}' AS kind, {rank} AS rk, unnest(x) AS m, "
    f"unnest(list_slice(string_split_regex(t, '{pattern}'), 1, len(x))) AS gap, generate_subscripts(x, 1) AS i "
    f"FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS x FROM d) z"
    for rank, (kind, pattern) in enumerate((("assign", ASSIGN.replace("'", "''")), ("access", ACCESS), ("hex", HEX),
                                            ("owner", BARE))))
ORACLES = {"op7_secrets": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM ({_FOUND_SQL}) u),
s AS (SELECT r, doc_id, source, t, kind, rk, e - length(m) AS b, e,
             CASE WHEN kind = 'assign' THEN regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2) ELSE m END AS v FROM f),
base AS (SELECT * FROM s WHERE (kind = 'assign' AND length(v) >= 12) OR (kind = 'access' AND length(v) >= 18) OR kind = 'hex'),
bare AS (SELECT * FROM s WHERE kind = 'owner' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
         AND {RUN} * length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           v, '[a-z]+', 'a', 'g'), '[A-Z]+', 'A', 'g'), '[0-9]+', '0', 'g'), '[_-]', '', 'g')) >= length(v)
         AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = s.r AND base.b < s.e AND s.b < base.e)),
seen AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT v, count(*) AS n_owners FROM (SELECT DISTINCT v, source FROM seen) o GROUP BY v),
live AS (SELECT v FROM owned WHERE n_owners <= {MAX_OWNERS}),
marked AS (SELECT seen.*, live.v IS NOT NULL AS alive FROM seen LEFT JOIN live ON seen.v = live.v),
per AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE alive) AS n_live,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rk, e) FILTER (WHERE kind <> 'owner') AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rk, e) FILTER (WHERE kind <> 'owner' OR alive) AS spans
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (r)
"""}
