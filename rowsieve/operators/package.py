"""Split into a clean set and an error set with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import RunConfig
from rowsieve.operators.corrections import active_error_rows
from rowsieve.operators.transform import enrich
from rowsieve.operators.validate import ROW_KEY


class PendingReviewError(RuntimeError):
    """Raised when results are asked for while rows still wait for a person."""


def blocking(
    pending: DataFrame,
    table: DataFrame,
    ledger: DataFrame,
    skipped: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """(scope, reason, n): what keeps a run from being packaged; no row where nothing does.

    ``queued`` errors wait for an answer; ``open`` rows are neither fixed nor skipped and still
    show the cell they were reported for: they would leave as clean ones. ``fields`` names the
    columns errors can be on; only these are read.
    """
    scope = list(row_key[:-1])
    still = active_error_rows(table, ledger, skipped, row_key, fields)
    reasons = pending.select(*scope, F.lit("queued").alias("reason")).unionByName(
        still.select(*scope, F.lit("open").alias("reason"))
    )
    return reasons.groupBy(*scope, "reason").agg(F.count("*").alias("n"))


def check_ready(
    status: str,
    pending: DataFrame,
    table: DataFrame | None = None,
    ledger: DataFrame | None = None,
    skipped: DataFrame | None = None,
    fields: Sequence[str] | None = None,
) -> None:
    """Refuse to package while the review is open.

    With a table and ledger, also refuse while an unskipped row still shows the cell it was
    reported for; otherwise such a row would leave as a clean one.
    """
    if status == "WAITING_FOR_USER" or not pending.isEmpty():
        raise PendingReviewError(f"status is {status}; answer the queued errors first")
    if table is not None and ledger is not None:
        if not active_error_rows(table, ledger, skipped, fields=fields).isEmpty():
            raise PendingReviewError("rows with open errors are neither fixed nor skipped")


def success_rows(
    df: DataFrame, skipped: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Rows that were not skipped."""
    return df.join(skipped.select(*row_key), list(row_key), "left_anti")


def error_reasons(
    ledger: DataFrame, skipped: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Messages of each skipped row in ledger order, from its latest pass that had errors.

    A row has at most one error per rule and pass, so each group is small.
    """
    key = list(row_key)
    pass_no = F.col("pass_no") if "pass_no" in ledger.columns else F.lit(0)
    entry = F.struct(
        pass_no.alias("pass_no"), F.col("rule_no"), F.col("error_message").alias("text")
    )
    gathered = (
        ledger.join(skipped.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(entry)).alias("all"))
    )
    latest = F.filter("all", lambda e: e["pass_no"] == F.element_at("all", -1)["pass_no"])
    reason = F.array_join(F.transform(latest, lambda e: e["text"]), "; ")
    return gathered.select(*key, reason.alias("error_reason"))


def error_rows(
    df: DataFrame,
    skipped: DataFrame,
    ledger: DataFrame,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """Skipped rows with ``error_reason`` as last column; empty text when none is known."""
    key = list(row_key)
    picked = df.join(skipped.select(*key), key, "left_semi")
    return picked.join(error_reasons(ledger, skipped, key), key, "left").withColumn(
        "error_reason", F.coalesce("error_reason", F.lit(""))
    )


def split_rows(
    df: DataFrame,
    skipped: DataFrame,
    ledger: DataFrame,
    config: RunConfig,
    row_key: Sequence[str] = ROW_KEY,
) -> tuple[DataFrame, DataFrame]:
    """Enriched clean set and enriched error set; together they are the input."""
    table = enrich(df, config)
    return success_rows(table, skipped, row_key), error_rows(table, skipped, ledger, row_key)


def package_counts(
    df: DataFrame, skipped: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Sizes of the two sets without building them: one narrow join."""
    key = list(row_key)
    marks = skipped.select(*key).distinct().withColumn("_skipped", F.lit(True))
    return (
        df.select(*key)
        .join(marks, key, "left")
        .agg(
            F.count_if(F.col("_skipped").isNull()).alias("valid_count"),
            F.count_if(F.col("_skipped")).alias("error_count"),
        )
    )
