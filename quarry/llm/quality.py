"""Operator 6: quality by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one over a bad one).  The
ranking learns one weight per text feature by logistic loss on the difference
of the two documents' features, without intercept: a document's worth is the
weighted sum of its features.  Worth is mapped to a probability of the good
label by a logistic curve fitted on rows held back from the ranking, and
documents are kept by a quantile of the scores.

Defined results: null and empty texts get the features of an empty text and so
a score; without labelled rows of both kinds every score is the sample's mean
label (1 without any: nothing is known against a document); repeated rows get
equal scores; an empty table gives no rows and no threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import crc_mod, materialize, small_batches, table
from quarry.llm.labelled import SAMPLE_ROWS, base_rate, in_both_parts, labelled_sample

THRESHOLD = 0.3
# Pairs a bad document takes part in.
PAIRS = 6
# Share of documents below the quantile threshold.
DROP_SHARE = 0.1
# Words a text is thought to have besides its own when the share of its most
# frequent word is taken, so that short texts need no rule of their own.
REPEAT_PRIOR = 10

_RUN = re.compile(r"[^\w\s]{2,}")
FEATURES = ("symbols", "bars", "exclaims", "double_marks", "capitals", "caps_words", "digits", "distinct_words",
            "top_word", "distinct_pairs", "repeated_lines", "no_letters", "word_length", "line_length",
            "marked_words", "length_log", "tiny")


def features_of(text: str) -> list[float]:
    """Rates in 0..1, steepened where a small rate already tells."""
    words = text.split()
    n, chars = len(words), len(text)
    per, ch = 1.0 / max(n, 1), 1.0 / max(chars, 1)
    count = Counter(words)
    caps = nolet = marked = letters = upper = 0
    for w, k in count.items():
        letters += len(w) * k
        if len(w) > 1 and w.isupper():
            caps += k
        if not any(map(str.isalpha, w)):
            nolet += k
        elif not w[-1].isalnum() and len(w) > 2 and not w[-2].isalnum():
            marked += k
        if w[0].isupper():
            upper += k
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    top = max(count.values(), default=0)
    symbols = sum(text.count(c) for c in "@#$%&*|~^<>{}[]=+\\")
    sat = lambda v, k: min(1.0, v * k)
    return [sat(symbols * ch, 10), sat(text.count("|") * per, 3), sat(text.count("!") * per, 3),
            sat(len(_RUN.findall(text)) * per, 3), sat(upper * per, 2), sat(caps * per, 2),
            sat(sum(text.count(c) for c in "0123456789") * ch, 5), len(count) * per if n else 1.0,
            sat(max(0.0, (top - 1) / (n + REPEAT_PRIOR) - 0.1), 3), len(pairs) / max(n - 1, 1) if n > 1 else 1.0,
            1.0 - len(set(lines)) / len(lines), sat(nolet * per, 3), min(1.0, letters * per / 12),
            min(1.0, math.log1p(chars / len(lines)) / 8), sat(marked * per, 3), min(1.0, math.log1p(n) / 9),
            1.0 if n < 5 else 0.0]


def featurize(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``v``, the feature vector of ``text``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [features_of(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x, pa.list_(pa.float64()))],
                                             names=[*keep, "x"])

    need = list(dict.fromkeys([*keep, "text"]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("x", T.ArrayType(T.DoubleType()))])
    d = docs.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(run, schema)
    return d.withColumn("v", array_to_vector("x")).drop("x")


def preference_pairs(x: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(diff, label): good minus bad with label 1 and the reverse with label 0.

    ``x`` is the bounded fitting sample (doc_id, y, v).  Rows of each label are
    numbered; bad row i meets good rows i * pairs + j, wrapped around, so the
    number of pairs is ``pairs`` times the smaller side, never the product.
    """
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id")
    good = x.where(F.col("y") > 0).select(F.col("v").alias("g"), (F.row_number().over(order) - 1).alias("gi"))
    bad = x.where(F.col("y") <= 0).select(F.col("v").alias("b"), (F.row_number().over(order) - 1).alias("bi"))
    n_good, n_bad = good.count(), bad.count()
    many, few, mi, fi, n = (good, bad, "gi", "bi", n_good) if n_good >= n_bad else (bad, good, "bi", "gi", n_bad)
    few = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(min(pairs, n) - 1))).alias("j"))
    few = few.withColumn("at", ((F.col(fi) * pairs + F.col("j")) % n).cast("int"))
    p = few.join(many.withColumnRenamed(mi, "at"), "at").select(
        F.zip_with(vector_to_array("g"), vector_to_array("b"), lambda a, c: a - c).alias("d"), F.col("at"))
    p = p.select("d", (F.pmod(F.xxhash64("d", "at"), F.lit(2))).cast("double").alias("label"))
    return p.select(array_to_vector(F.when(F.col("label") == 1, F.col("d")).otherwise(
        F.transform("d", lambda a: -a))).alias("diff"), "label")


class QualityModel:
    """Feature weights of the ranking, and the curve from worth to probability."""

    def __init__(self, weights: list[float], slope: float, shift: float, constant: float | None = None):
        self.weights, self.slope, self.shift, self.constant = weights, slope, shift, constant

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", fold_mod: int = 5, held: int = 0,
            rows: int = SAMPLE_ROWS) -> QualityModel:
        sample = materialize(labelled_sample(docs, labels, label, fold_mod, held, rows), "quality-sample")
        parts = in_both_parts(sample)
        if parts is None:
            return cls([], 0.0, 0.0, base_rate(sample) if sample.head(1) else 1.0)
        x = materialize(featurize(parts, ["doc_id", "y", "part", "text"]).drop("text"), "quality-features")
        pairs = preference_pairs(x.where(F.col("part") == 0))
        rank = LogisticRegression(featuresCol="diff", labelCol="label", fitIntercept=False, regParam=1e-3,
                                  maxIter=60).fit(pairs)
        weights = [float(w) for w in rank.coefficients]
        cal = x.where(F.col("part") == 1).select("y", array_to_vector(F.array(cls._worth(weights))).alias("w"))
        curve = LogisticRegression(featuresCol="w", labelCol="y", regParam=1e-4, maxIter=60).fit(cal)
        # more worth never means a lower probability
        return cls(weights, max(0.0, float(curve.coefficients[0])), float(curve.intercept))

    @staticmethod
    def _worth(weights: list[float]):
        return F.aggregate(F.zip_with(vector_to_array("v"), F.array(*[F.lit(w) for w in weights]),
                                      lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of (doc_id, text)."""
        if self.constant is not None:
            return docs.select("doc_id", F.lit(self.constant).alias("score"))
        z = self._worth(self.weights) * F.lit(self.slope) + F.lit(self.shift)
        return featurize(docs, ["doc_id"]).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def keep_by_quantile(scored: DataFrame, drop_share: float = DROP_SHARE) -> DataFrame:
    """Adds ``kept``: the score reaches the ``drop_share`` quantile of all scores."""
    q = scored.agg(F.percentile_approx("score", drop_share, 10_000)).head()[0]
    return scored.withColumn("kept", F.col("score") >= F.lit(q if q is not None else 0.0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = QualityModel.fit(docs, table(spark, sf_dir, "labels"))
    scored = keep_by_quantile(materialize(model.score(docs), "quality-scores"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "kept")


QUERIES = {"op6_quality": op6_quality}
