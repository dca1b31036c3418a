"""Added columns: lookup, expression, static and the computed expense columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import UNMAPPED, RunConfig
from rowsieve.functions.text import as_money, shown
from rowsieve.operators.groups import lookup_join
from rowsieve.operators.validate import ROW_KEY

# --- fixed values -----------------------------------------------------------
APPROVAL_DEPT = "FIN"
APPROVAL_ABOVE = 50000
MISSING_AMOUNT = 0
MISSING_RATE = 1
# --- end of fixed values ----------------------------------------------------

# Larger maps are joined instead of being written into the plan.
LITERAL_MAP_KEYS = 1_000


def _map_value(key: Column, mapping: Mapping[str, str], unmapped: str | None) -> Column:
    if not mapping:
        return F.lit(unmapped).cast("string")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    # A key that maps to null is known: its value is null, not the word for unknown keys.
    return F.when(F.map_contains_key(table, key), table[key]).otherwise(F.lit(unmapped))


def lookup_column(
    df: DataFrame,
    name: str,
    source: str,
    mapping: Mapping[str, str],
    unmapped: str | None = UNMAPPED,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """``name`` = the value ``mapping`` holds for the text of ``source``, else ``unmapped``."""
    if source not in df.columns:
        return df.withColumn(name, F.lit(unmapped).cast("string"))
    if len(mapping) > LITERAL_MAP_KEYS:
        rows = df.sparkSession.createDataFrame(
            list(mapping.items()), "map_key string, map_value string"
        )
        return lookup_table_column(df, name, source, rows, unmapped, row_key)
    return df.withColumn(name, _map_value(shown(F.col(source)), mapping, unmapped))


def lookup_table_column(
    df: DataFrame,
    name: str,
    source: str,
    table: DataFrame,
    unmapped: str | None = UNMAPPED,
    row_key: Sequence[str] = ROW_KEY,
    **join_options: int,
) -> DataFrame:
    """Like :func:`lookup_column` with the map in a table (``map_key``, ``map_value``).

    Rows keep their number: of several values for one key the smallest counts, null only if
    the key has no other. Null keys match nothing.
    """
    entries = (
        table.filter(F.col("map_key").isNotNull())
        .groupBy(F.col("map_key").alias("_key"))
        .agg(F.min("map_value").alias("_value"))
        .withColumn("_known", F.lit(True))
    )
    keyed = df.withColumn("_key", shown(F.col(source)))
    joined = lookup_join(keyed, entries, "_key", row_key, **join_options)
    value = F.when(F.col("_known"), F.col("_value")).otherwise(F.lit(unmapped))
    return joined.withColumn(name, value).drop("_key", "_value", "_known")


def expression_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """``name`` = a SQL expression over the row; ``<name>_error`` tells where it has no value.

    Write the expression with ``try_*`` functions so that a bad cell gives null.
    """
    failed = F.when(F.col(name).isNull(), F.lit(f"ERROR: no value for {expression}"))
    return df.withColumn(name, F.expr(expression)).withColumn(f"{name}_error", failed)


def static_column(df: DataFrame, name: str, value: str | None) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast("string"))


def transform_column(
    df: DataFrame,
    name: str,
    default_value: str | None = None,
    expression: str | None = None,
    lookup_field: str | None = None,
    lookup_map: Mapping[str, str] | None = None,
    unmapped_value: str | None = UNMAPPED,
) -> DataFrame:
    """Add or replace one column; a lookup wins over an expression, that over a static value."""
    if lookup_map is not None and lookup_field is None:
        raise ValueError("lookup_map requires lookup_field.")
    if lookup_field is not None and lookup_map is None:
        raise ValueError("lookup_field requires lookup_map.")
    if lookup_map is not None:
        return lookup_column(df, name, lookup_field, lookup_map, unmapped_value)
    if expression:
        return expression_column(df, name, expression)
    return static_column(df, name, default_value)


def _money(df: DataFrame, name: str, missing: int) -> Column:
    parsed = as_money(F.col(name)) if name in df.columns else F.lit(None)
    return F.coalesce(parsed.cast("decimal(18,6)"), F.lit(missing).cast("decimal(18,6)"))


def amount_usd(df: DataFrame, places: int = 2) -> Column:
    """amount x fx_rate, rounded half up; a bad amount counts as 0, a bad rate as 1."""
    product = _money(df, "amount", MISSING_AMOUNT) * _money(df, "fx_rate", MISSING_RATE)
    return F.round(product, places).try_cast("decimal(18,2)")


def cost_center(df: DataFrame, config: RunConfig) -> Column:
    dept = shown(F.col("dept")) if "dept" in df.columns else F.lit("")
    return _map_value(dept, config.cost_centers, UNMAPPED)


def approval_required(df: DataFrame) -> Column:
    """YES for a large amount of the finance department, in the currency of the row."""
    dept = F.col("dept") if "dept" in df.columns else F.lit("")
    large = _money(df, "amount", MISSING_AMOUNT) > APPROVAL_ABOVE
    return F.when((dept == APPROVAL_DEPT) & large, F.lit("YES")).otherwise(F.lit("NO"))


def enrich(df: DataFrame, config: RunConfig) -> DataFrame:
    """All computed columns in one projection; running it twice changes nothing."""
    return df.withColumns(
        {
            "amount_usd": amount_usd(df, config.usd_places),
            "cost_center": cost_center(df, config),
            "approval_required": approval_required(df),
        }
    )
