"""Row fingerprints that do not depend on column order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
NULL_MARK = "~"
VALUE_MARK = "="
LENGTH_END = ":"
FLOAT_PLACES = 6
# --- end of fixed values ----------------------------------------------------


def _cell_text(field: T.StructField) -> Column:
    cell = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        # NaN and null count as the same value; adding 0.0 folds -0.0 into 0.0.
        cell = F.when(~F.isnan(cell), F.round(cell.cast("double"), FLOAT_PLACES) + F.lit(0.0))
    text = cell.cast("string")
    # The length in front makes cells unambiguous without escaping them.
    length = F.length(text).cast("string")
    valued = F.concat(F.lit(field.name + VALUE_MARK), length, F.lit(LENGTH_END), text)
    return F.coalesce(valued, F.lit(field.name + NULL_MARK))


def canonical_row(df: DataFrame, exclude: Iterable[str] = ("row_index",)) -> Column:
    """One text per row: cells in column-name order, unambiguous for any content."""
    skip = set(exclude)
    fields = sorted((f for f in df.schema.fields if f.name not in skip), key=lambda f: f.name)
    return F.concat(*[_cell_text(f) for f in fields])


def row_fingerprint(df: DataFrame, exclude: Iterable[str] = ("row_index",)) -> Column:
    """SHA-256 hex digest of the canonical row."""
    return F.sha2(canonical_row(df, exclude), 256)


def with_fingerprint(df: DataFrame, exclude: Iterable[str] = ("row_index",)) -> DataFrame:
    return df.withColumn("row_fp", row_fingerprint(df, exclude))
