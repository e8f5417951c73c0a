"""Operator 10: toxicity by gradient-boosted trees over dense features.

1. A lexicon is learned from a bounded sample of labelled documents: words and
   word beginnings of 4 to 8 letters whose share of toxic documents is far
   above chance (likelihood-ratio test against the number of units tried).
2. Every whole text becomes a dense vector: lexicon densities, nearness of
   lexicon words to second-person words, capitals, punctuation and obfuscation
   rates.
3. Gradient-boosted trees are fitted on part of the sample, their margin is
   calibrated to a probability by isotonic regression on the other part.

Defined results: null and empty texts get the features of an empty text and so
a score; without labelled rows of both kinds every score is the sample's mean
label (0 without any); repeated rows get equal scores; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import crc_mod, materialize, small_batches, table
from quarry.llm.labelled import SAMPLE_ROWS, base_rate, in_both_parts, labelled_sample

THRESHOLD = 0.7
# Lexicon units kept, at most, by their test value.
LEXICON_UNITS = 5000
MIN_ODDS = math.log(4)
STEMS = (4, 5, 6, 7, 8)
NEAR = 5
# fixed values: second-person words in English, German, French and Spanish
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                       "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_EDGE = ".,;:!?\"'()[]{}<>«»„“”…"
_SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
_LONG = re.compile(r"([^\W\d_])\1{2,}")

FEATURES = ("hits_log", "hits_per_word", "stem_log", "stem_per_word", "distinct_hits", "weight_max",
            "weight_mean", "weight_log", "weight_per_word", "near_log", "near_share", "second_person", "capitals", "caps_words", "exclaim",
            "punctuation", "mixed_words", "hidden_log", "spaced", "stretched", "symbols", "length_log")


def units(word: str) -> list[str]:
    """The word itself and its beginnings (marked with a star) of 4 to 8 letters."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def plain(word: str) -> str:
    return word.lower().strip(_EDGE)


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_UNITS) -> dict[str, float]:
    """unit -> log odds of toxic, from the fitting part of the sample."""
    fit = sample.where(F.col("part") == 0)

    def count(batches):
        n: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen = {u for w in {plain(w) for w in text.split()} if w for u in units(w)}
                for u in seen:
                    n.setdefault(u, [0, 0])[y > 0] += 1
        if n:
            a = np.array(list(n.values()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(a[:, 0]), pa.array(a[:, 1])],
                                             names=["unit", "clean", "toxic"])

    tot = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(v for k, v in tot.items() if k > 0), sum(v for k, v in tot.items() if k <= 0)
    if not n1 or not n0:
        return {}
    c = materialize(fit.select("text", "y").mapInArrow(count, "unit string, clean long, toxic long")
                    .groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
                    .where(F.col("clean") + F.col("toxic") >= 2), "lexicon")
    tried = max(2, c.count())
    t, k = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p, base = t / (t + k), n1 / (n1 + n0)
    ll = t * F.log(F.greatest(p, F.lit(1e-12)) / base) + k * F.log(F.greatest(1 - p, F.lit(1e-12)) / (1 - base))
    odds = F.log((t + 0.5) / (n1 + 1)) - F.log((k + 0.5) / (n0 + 1))
    rows = (c.select("unit", (2 * ll).alias("g"), odds.alias("odds"))
            .where((F.col("odds") >= MIN_ODDS) & (F.col("g") >= 2 * math.log(tried) + 4))
            .orderBy(F.col("g").desc(), "unit").limit(limit).collect())
    return {r["unit"]: r["odds"] for r in rows}


def features_of(text: str, lexicon: dict[str, float]) -> list[float]:
    words = text.split()
    n = len(words)
    chars = len(text)
    count = Counter(words)
    hits = stems = hidden = mixed = caps = second = 0
    mass = 0.0
    weights: list[float] = []
    bad: set[str] = set()
    you: set[str] = set()
    for raw, k in count.items():
        w = raw.lower().strip(_EDGE)
        if w in SECOND_PERSON:
            second += k
            you.add(raw)
        if len(raw) > 2 and raw.isupper():
            caps += k
        if not w:
            continue
        best = lexicon.get(w)
        if best is not None:
            hits += k
        else:
            for m in STEMS:
                if len(w) >= m:
                    s = lexicon.get(w[:m] + "*")
                    if s is not None and (best is None or s > best):
                        best = s
            if best is not None:
                stems += k
        if not w.isalpha() and not w.isdigit():
            mixed += k
            if best is None:
                flat = w.translate(_LEET)
                best = lexicon.get(flat) if flat != w else None
                if best is not None:
                    hidden += k
        if best is not None:
            weights.append(best)
            mass += best * k
            bad.add(raw)
    near = 0
    if bad and you:
        last = -NEAR - 1
        at = [i for i, w in enumerate(words) if w in you]
        j = 0
        for i, w in enumerate(words):
            if w in bad:
                while j < len(at) and at[j] < i:
                    last = at[j]
                    j += 1
                if i - last <= NEAR or (j < len(at) and at[j] - i <= NEAR):
                    near += 1
    total = hits + stems + hidden
    per = 1.0 / max(n, 1)
    ch = 1.0 / max(chars, 1)
    upper = _upper(text)
    marks = text.count("!") + text.count("?")
    symbols = sum(text.count(c) for c in "@#$%&*|~^")
    punct = sum(text.count(c) for c in ".,;:") + marks
    return [math.log1p(hits), hits * per, math.log1p(stems), stems * per, float(len(bad)),
            max(weights, default=0.0), sum(weights) / len(weights) if weights else 0.0,
            math.log1p(mass), mass * per, math.log1p(near), near / total if total else 0.0, second * per, upper * ch, caps * per,
            marks * ch, punct * ch, mixed * per, math.log1p(hidden),
            len(_SPACED.findall(text)) * per,
            sum(1 for w in bad if _LONG.search(w)) * per, symbols * ch, math.log1p(n)]


def _upper(text: str) -> int:
    """Unicode capitals; counted in bytes where all characters are ASCII."""
    if not text.isascii():
        return sum(map(str.isupper, text))
    a = np.frombuffer(text.encode(), np.uint8)
    return int(((a >= 65) & (a <= 90)).sum())


def featurize(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the dense features of the text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for b in batches:
            x = [features_of(t or "", lex) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x, pa.list_(pa.float64()))],
                                             names=[*keep, "x"])

    need = list(dict.fromkeys([*keep, text_col]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(run, schema)


class ToxicityModel:
    """Lexicon, trees and calibration; ``score`` adds a probability to any documents."""

    def __init__(self, lexicon, trees, curve, constant):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", fold_mod: int = 3, held: int = 1,
            rows: int = SAMPLE_ROWS, rounds: int = 20, depth: int = 3) -> ToxicityModel:
        sample = materialize(labelled_sample(docs, labels, label, fold_mod, held, rows), "tox-sample")
        parts = in_both_parts(sample)
        if parts is None:
            return cls({}, None, None, base_rate(sample))
        lexicon = learn_lexicon(parts)
        x = featurize(parts, lexicon, ["y", "part"]).select("y", "part", array_to_vector("x").alias("v"))
        x = materialize(x, "tox-features").coalesce(8)
        gbt = GBTClassifier(featuresCol="v", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.3,
                            minInstancesPerNode=3, seed=11)
        trees = gbt.fit(x.where(F.col("part") == 0))
        m = cls._margin(trees, x.where(F.col("part") == 1))
        curve = IsotonicRegression(featuresCol="margin", labelCol="y").fit(m.select("margin", "y"))
        return cls(lexicon, trees, curve, None)

    @staticmethod
    def _margin(trees, x: DataFrame) -> DataFrame:
        return trees.transform(x).withColumn("margin", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns of ``docs`` and ``__score``."""
        if self.trees is None:
            return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(self.constant).alias("__score"))
        names = {c: f"k{i}" for i, c in enumerate(keep)}
        text = names.get("text", "text")
        d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *(["text"] if text == "text" else []))
        x = featurize(d, self.lexicon, list(names.values()), text).withColumn("v", array_to_vector("x"))
        m = self.curve.transform(self._margin(self.trees, x).drop("prediction"))
        return m.select(*[F.col(n).alias(c) for c, n in names.items()],
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("__score"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored toxic, all columns kept."""
    model = ToxicityModel.fit(docs, labels)
    return model.score(docs, docs.columns).where(F.col("__score") < threshold).drop("__score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"))
    s = model.score(docs, ["doc_id"])
    return s.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("__score").alias("score"),
                    (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
