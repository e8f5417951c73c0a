"""What the catalog says about the data: counts, smallest values and sample rows.

* Counts are taken once for the state a database is in, written under the
  checkpoint folder and read by every query that asks for them.  Tables of flat
  columns are counted from the Parquet footers, no data page is read.
* The smallest values of a column and the first rows of a table are found
  behind a bound: a first read says how large they can be at most, the second
  has it as a filter on the scan, so that row groups behind it are skipped.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import TABLE_NAMES, Tables, path_exists, path_state, scratch_path

PROFILE_SCHEMA = "`table` string, name string, n_rows long, n_nulls long"
_written: dict[tuple, str] = {}


# ---------------------------------------------------------------- counts

def column_profile(t: Tables) -> DataFrame:
    """(table, name, n_rows, n_nulls): rows and nulls of every column.

    Counted anew only when the size, the number of files or the time of a table
    has changed since this application counted last.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir, *(path_state(t.spark, t.path(n)) for n in TABLE_NAMES))
    path = _written.get(key)
    if path is None or not path_exists(t.spark, path):
        path = scratch_path(t.spark, "profile")
        _write_profile(t, path)
        _written[key] = path
    return t.spark.read.schema(PROFILE_SCHEMA).parquet(path)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own in which counts are answered from Parquet footers."""
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def table_counts(df: DataFrame) -> DataFrame:
    """(n_rows, k0, k1, ..): rows, and values that are there by column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{c}`")).alias(f"k{i}")
                                                       for i, c in enumerate(df.columns)])


def _is_flat(schema: T.StructType) -> bool:
    return all(isinstance(f.dataType, T.AtomicType) for f in schema.fields)


def _write_profile(t: Tables, path: str) -> None:
    footers = footer_session(t.spark)
    found = []  # one entry a column of the catalog
    for name in TABLE_NAMES:
        df = t[name]
        row = None
        if _is_flat(df.schema):
            try:
                row = table_counts(footers.read.parquet(t.path(name))).first()
            except (PySparkException, Py4JJavaError):  # footers without statistics of some column
                row = None
        row = row or table_counts(df).first()
        found += [(name, c, row["n_rows"], row["n_rows"] - row[f"k{i}"]) for i, c in enumerate(df.columns)]
    t.spark.createDataFrame(found, PROFILE_SCHEMA).coalesce(1).write.parquet(path)


# ---------------------------------------------------------------- smallest values

# Rows of a table that give the first bounds.
FIRST_ROWS = 1000
# Groups whose smallest values give the second bound of a column.
GROUPS = 1024
# Characters of a bound that are kept; behind them stands the last code point.
BOUND_CHARS = 200
_LAST = chr(0x10FFFF)


def _bound_text(value: str) -> str:
    """A text not below ``value``, at most ``BOUND_CHARS`` + 1 characters where these suffice."""
    if len(value) <= BOUND_CHARS or value[BOUND_CHARS] == _LAST:
        return value
    return value[:BOUND_CHARS] + _LAST


def _first_bounds(df: DataFrame, cols: list[str], n: int) -> dict[str, str]:
    """By column, the n-th smallest distinct value of a thousand rows; none where there are fewer values."""
    few = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).limit(FIRST_ROWS)
    row = few.agg(*[F.get(F.array_sort(F.collect_set(f"c{i}")), n - 1).alias(f"c{i}") for i in range(len(cols))]).first()
    return {c: _bound_text(row[i]) for i, c in enumerate(cols) if row[i] is not None}


def smallest_values(tables: dict[str, tuple[DataFrame, list[str]]], n: int) -> DataFrame:
    """(table, column, value): the ``n`` smallest distinct values of the given text columns.

    A column with ``n`` values among the first rows is read twice behind a
    bound.  The first time the smallest value of each of 1,024 groups by hash
    is kept; the n-th smallest of these is the second bound, which hardly more
    than ``n`` values lie below.  Columns of fewer values are made distinct,
    before they are shuffled.  Nulls are no values.
    """
    wide, narrow = [], []
    for table, (df, cols) in tables.items():
        bounds = _first_bounds(df, cols, n)
        for c in cols:
            v = F.col(f"`{c}`")
            d = df.select(v.alias("value")).where(v.isNotNull())
            (wide if c in bounds else narrow).append(
                (table, c, d.where(F.col("value") <= bounds[c]) if c in bounds else d))
    if wide:
        least = [d.groupBy(F.pmod(F.xxhash64("value"), F.lit(GROUPS)).alias("g")).agg(F.min("value").alias("value"))
                 .select(F.lit(i).alias("i"), "value") for i, (_, _, d) in enumerate(wide)]
        at = Window.partitionBy("i").orderBy("value")
        nth = (_union(least).withColumn("r", F.row_number().over(at)).where(F.col("r") == n)
               .select("i", "value").collect())  # one text a column
        second = {r["i"]: _bound_text(r["value"]) for r in nth}
        wide = [(tb, c, d.where(F.col("value") <= second[i]) if i in second else d)
                for i, (tb, c, d) in enumerate(wide)]
    parts = [d.distinct().select(F.lit(tb).alias("table"), F.lit(c).alias("column"), "value")
             for tb, c, d in (*wide, *narrow)]
    w = Window.partitionBy("table", "column").orderBy("value")
    return _union(parts).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- sample rows

def number_text(x: Column) -> Column:
    """A fraction with up to six places, at least one."""
    plain = F.round(x.cast("double"), 6).cast("decimal(38,6)").cast("string")
    text = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", ".0")
    return F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e30), x.cast("string")).otherwise(text)


def quoted(x: Column) -> Column:
    """A text in quotes, as Python shows it (characters without a picture stay as they are)."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return (F.when(~F.contains(x, F.lit("'")), F.concat(F.lit("'"), x, F.lit("'")))
            .when(~F.contains(x, F.lit('"')), F.concat(F.lit('"'), x, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def value_text(x: Column, kind: T.DataType) -> Column:
    """A value as Python shows it: None, True, 12, 1.5, 'text', [..]; times to the second, in quotes."""
    if isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: value_text(e, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        body = quoted(x)
    elif isinstance(kind, T.BooleanType):
        body = F.when(x, "True").otherwise("False")
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        body = number_text(x)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        body = F.concat(F.lit("'"), F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    elif isinstance(kind, T.IntegralType):
        body = x.cast("string")
    else:
        body = quoted(F.to_json(F.struct(x)) if isinstance(kind, (T.StructType, T.MapType)) else x.cast("string"))
    return F.when(x.isNull(), F.lit("None")).otherwise(body)


def row_text(schema: T.StructType) -> Column:
    """A row as ``{'column': value, ...}``."""
    fields = [F.concat(F.lit(f"'{f.name}': "), value_text(F.col(f"`{f.name}`"), f.dataType)) for f in schema.fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """One row, ``rows``: the texts of the ``n`` first rows by key, ties by their texts; rows without a key aside.

    The keys alone are read for the n-th of them; the rows are then looked up behind it.
    """
    df = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in key)))
    last = df.select(*key).orderBy(*key).limit(n).collect()
    if last:
        df = df.where(F.col(key[0]) <= last[-1][0])
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    order = [f"k{i}" for i in range(len(key))] + ["text"]
    few = df.select(*keys, row_text(df.schema).alias("text")).orderBy(*order).limit(n)
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda r: r["text"]).alias("rows"))


def sample_texts(t: Tables, keys: dict[str, list[str]], n: int) -> DataFrame:
    """(table, rows): the texts of the first ``n`` rows of each table named in ``keys``."""
    return _union([first_rows(t[name], key, n).select(F.lit(name).alias("table"), "rows") for name, key in keys.items()])
