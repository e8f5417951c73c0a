"""Report number formatting with Python's format-spec rounding.

Percent and fixed-point texts in the reports are rounded from the exact
binary value, half to even (e.g. 0.5625 -> '56.2%').  Java's formatter
behind ``format_string`` rounds half up ('56.3%'), and no built-in rounds
the exact binary expansion, so this one helper is an Arrow-batched pandas
UDF.  It only ever runs on aggregated report rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def py_format(c, spec: str) -> Column:
    """``format(x, spec)`` per value (NULL stays NULL)."""
    @F.pandas_udf("string")
    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or pd.isna(x) else format(float(x), spec))
    return fmt(col_(c).cast("double"))
