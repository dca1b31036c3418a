"""Rule evaluation: error ledger, duplicate check, summary, review batch.

The ledger is built without joining the wide table to anything: row rules need no
shuffle, and the duplicate check shuffles only its key columns and the row index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import REVIEW_BATCH_ROWS
from rowsieve.functions.text import render, shown
from rowsieve.operators.groups import PIECE_ROWS, value_before
from rowsieve.operators.rules import RuleSet, UniqueRule

LEDGER_FIELDS = ("rule_no", "field", "current_value", "error_message")
ROW_KEY = ("row_index",)


def row_errors(df: DataFrame, rules: RuleSet, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Ledger rows of the row rules: one scan, one generated loop, no shuffle."""
    typed = rules.with_parsed(df)
    return (
        typed.select(*row_key, F.explode(rules.errors(typed)).alias("e"))
        .filter(F.col("e").isNotNull())
        .select(*row_key, *[F.col(f"e.{name}") for name in LEDGER_FIELDS])
    )


def key_texts(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Key cells as text, so null and the word "None" meet, as in the messages."""
    return {
        f"key_{c}": shown(F.col(c)) if c in df.columns else F.lit("") for c in columns
    }


def repeated_rows(
    df: DataFrame,
    columns: Sequence[str],
    row_key: Sequence[str] = ROW_KEY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Rows that have an earlier row with the same ``columns``, with its index as ``prev_row``."""
    keys = key_texts(df, columns)
    narrow = df.select(*row_key, *[text.alias(name) for name, text in keys.items()])
    seen = with_previous_row(narrow, list(keys), row_key, piece_rows)
    return seen.filter(F.col("prev_row").isNotNull())


def with_previous_row(
    df: DataFrame,
    keys: Sequence[str],
    row_key: Sequence[str],
    piece_rows: int = PIECE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``prev_row``, the closest earlier row with the same keys; one shuffle by key."""
    *scope, index = row_key
    return value_before(
        df, [*scope, *keys], index, F.col(index), "prev_row", piece_rows=piece_rows, rows=rows
    )


def duplicate_entry(rule: UniqueRule) -> dict[str, Column]:
    """Ledger fields of a repeat, from its key texts and ``prev_row``."""
    cells = {c: F.col(f"key_{c}") for c in rule.columns}
    return {
        "rule_no": F.lit(rule.rule_no),
        "field": F.lit(rule.field),
        "current_value": cells[rule.field],
        "error_message": render(rule.text, previous=F.col("prev_row").cast("string"), **cells),
    }


def duplicate_errors(
    df: DataFrame,
    rule: UniqueRule,
    row_key: Sequence[str] = ROW_KEY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Ledger rows of the unique rule."""
    repeats = repeated_rows(df, rule.columns, row_key, piece_rows)
    entry = [value.alias(name) for name, value in duplicate_entry(rule).items()]
    return repeats.select(*row_key, *entry)


def exclude_rows(df: DataFrame, rows: DataFrame | None, row_key: Sequence[str] = ROW_KEY):
    """Drop the rows named in ``rows``; no size is assumed, Spark measures and picks the join."""
    return df if rows is None else df.join(rows.select(*row_key), list(row_key), "left_anti")


def error_ledger(
    df: DataFrame,
    rules: RuleSet,
    skipped: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """One row per (row, failed rule).

    Rows in ``skipped`` report nothing, but still count as earlier occurrences in the
    duplicate check. The skip set is applied to the few error rows, not to the table.
    """
    ledger = row_errors(df, rules, row_key)
    if rules.unique is not None:
        repeats = duplicate_errors(df, rules.unique, row_key, piece_rows)
        ledger = ledger.unionByName(repeats)
    return exclude_rows(ledger, skipped, row_key)


def tally(*parts: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """One row of counts over several DataFrames.

    Each is reduced to one row of partial counts; those few rows are then added up.
    """
    names = [name for _, aggs in parts for name in aggs]
    reduced = None
    for df, aggs in parts:
        row = df.agg(*[agg.alias(name) for name, agg in aggs.items()]).select(
            *[(F.col(n) if n in aggs else F.lit(0)).cast("long").alias(n) for n in names]
        )
        reduced = row if reduced is None else reduced.union(row)
    return reduced.agg(*[F.sum(n).alias(n) for n in names])


def validation_summary(
    df: DataFrame,
    ledger: DataFrame,
    unchecked: DataFrame | None = None,
    batch_rows: int = REVIEW_BATCH_ROWS,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """One row of counts. ``unchecked`` holds the rows the pass did not check."""
    distinct_rows = F.countDistinct(*row_key)
    parts = [
        (df, {"total_rows": F.count("*")}),
        (ledger, {"error_count": distinct_rows}),
        (
            review_batch(ledger, batch_rows, row_key),
            {"pending_review_count": F.count("*"), "batch_size": distinct_rows},
        ),
    ]
    if unchecked is not None:
        parts.append((unchecked, {"skipped_unchanged": F.count("*")}))
    counts = tally(*parts)
    unchanged = F.col("skipped_unchanged") if unchecked is not None else F.lit(0).cast("long")
    return counts.select(
        "total_rows",
        (F.col("total_rows") - F.col("error_count")).alias("valid_count"),
        "error_count",
        unchanged.alias("skipped_unchanged"),
        "pending_review_count",
        "batch_size",
    )


def review_batch(
    ledger: DataFrame,
    batch_rows: int = REVIEW_BATCH_ROWS,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """All errors of the ``batch_rows`` lowest error rows.

    The lowest rows are found on the row key alone, a top-k per task; whatever number of errors
    they have, the ledger is then filtered by those ``batch_rows`` keys.
    """
    lowest = ledger.select(*row_key).distinct().orderBy(*row_key).limit(batch_rows)
    return ledger.join(F.broadcast(lowest), list(row_key), "left_semi")  # batch_rows rows


def errors_by_row(ledger: DataFrame, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Errors of each row as an array in rule order; at most one entry per rule."""
    entry = F.struct("rule_no", "field", "current_value", "error_message")
    return ledger.groupBy(*row_key).agg(F.sort_array(F.collect_list(entry)).alias("errors"))


def error_row_count(
    ledger: DataFrame, approximate: bool = False, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Number of rows with at least one error."""
    if approximate:
        counted = F.approx_count_distinct(F.struct(*row_key))
    else:
        counted = F.countDistinct(*row_key)
    return ledger.agg(counted.alias("error_rows"))


def error_rows_by_field(ledger: DataFrame, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Error rows and errors per field; distinct rows are counted with a partial step first."""
    per_row = ledger.groupBy("field", *row_key).agg(F.count("*").alias("n"))
    return per_row.groupBy("field").agg(
        F.count("*").alias("error_rows"), F.sum("n").alias("errors")
    )


def completion_metrics(df: DataFrame, pending: DataFrame, skipped: DataFrame) -> DataFrame:
    """Totals shown at the end of a run.

    Errors are the queued errors while any are queued, else the skipped rows.
    """
    counts = tally(
        (df, {"total_rows": F.count("*")}),
        (pending, {"fixed_count": F.count("*")}),
        (skipped, {"skipped_rows": F.count("*")}),
    )
    errors = F.when(F.col("fixed_count") > 0, F.col("fixed_count")).otherwise(
        F.col("skipped_rows")
    )
    return counts.select(
        "total_rows",
        (F.col("total_rows") - errors).alias("valid_count"),
        errors.alias("error_count"),
        "fixed_count",
    )


def outcome_status(ledger: DataFrame) -> DataFrame:
    """The status a pass ends in, as one row: WAITING_FOR_USER with errors, else VALIDATING."""
    found = ledger.limit(1).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") > 0, F.lit("WAITING_FOR_USER")).otherwise(F.lit("VALIDATING"))
    return found.select(status.alias("status"))
