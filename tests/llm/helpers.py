"""Small tables and plain-Python versions used by the operator tests."""

import zlib

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                      T.StructField("toxic", T.IntegerType())])
BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])

LONG = " ".join(f"word{i % 997} text{i % 31}" for i in range(30_000))


def doc_rows():
    """Nulls in any column, empty, tiny and very long texts, repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"
    return [
        (1, base, "en", "a", 10), (1, base, "en", "a", 10), (2, base, "en", None, None),
        (3, None, None, "a", None), (4, "", "en", "b", 0), (5, "   \t\n ", "en", "b", 6),
        (6, "one two", None, "b", 7), (7, LONG, "en", "c", len(LONG)), (None, "null id text here", "en", "c", 5),
        (None, None, None, None, None), (8, base.upper(), "en", "c", 3), (9, base + " now", "en", "a", 3),
        (10, "naïve ÉCOLE straße 漢字 😀 word", "fr", "a", 3),
    ]


def docs(spark, rows=None, extra=()):
    df = spark.createDataFrame(doc_rows() if rows is None else rows, DOC)
    from pyspark.sql import functions as F
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def crc(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def words(text):
    return (text or "").encode().lower().split()
