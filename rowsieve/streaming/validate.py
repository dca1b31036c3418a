"""Continuous validation of arriving rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rowsieve.operators.cache_log import append_version, compact, current_cache
from rowsieve.operators.incremental import cache_of, row_states
from rowsieve.operators.rules import RuleSet
from rowsieve.operators.validate import ROW_KEY, row_errors
from rowsieve.streaming.files import append_available, each_available


def validate_arrivals(
    stream: DataFrame,
    rules: RuleSet,
    path: str,
    checkpoint: str,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """Ledger of the row rules: stateless, so batches of any size pass through."""
    return append_available(row_errors(stream, rules, row_key), path, checkpoint)


def revalidate_arrivals(
    stream: DataFrame,
    rules: RuleSet,
    cache: DataFrame,
    path: str,
    checkpoint: str,
    row_key: Sequence[str] = ROW_KEY,
) -> DataFrame:
    """Row states against a fixed fingerprint cache, batch by batch.

    Only row rules run here; repeats across batches are the business of
    :mod:`rowsieve.streaming.duplicates`.
    """
    row_rules = RuleSet(rules.row_rules)

    def handle(batch: DataFrame, batch_id: int) -> None:
        states = row_states(batch, row_rules, cache=cache, row_key=row_key)
        states.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    each_available(stream, handle, checkpoint)
    return stream.sparkSession.read.parquet(path).drop("batch")


def revalidate_with_feedback(
    stream: DataFrame,
    rules: RuleSet,
    cache: DataFrame,
    log: str,
    path: str,
    checkpoint: str,
    row_key: Sequence[str] = ROW_KEY,
    compact_every: int = 50,
) -> DataFrame:
    """Row states and ``batch``, each batch against what the batches before it found.

    ``cache`` is where the log starts. A batch reads the versions before its own and writes its
    entries as its version; handed over again after a failure it reads the same and overwrites
    the same. Every ``compact_every`` batches the log is put together.
    """
    row_rules = RuleSet(rules.row_rules)
    spark = stream.sparkSession
    append_version(cache, log, 0, row_key)

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = current_cache(spark, log, batch_id + 1, row_key)
        states = row_states(batch, row_rules, cache=known, row_key=row_key)
        target = f"{path}/batch={batch_id}"
        states.write.mode("overwrite").parquet(target)
        written = spark.read.schema(states.schema).parquet(target)
        append_version(cache_of(written, row_rules, row_key), log, batch_id + 1, row_key)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, log, batch_id + 1, row_key)

    each_available(stream, handle, checkpoint)
    return spark.read.parquet(path)


def row_rule_cache(df: DataFrame, rules: RuleSet, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """The cache a batch pass with only the row rules leaves behind."""
    row_rules = RuleSet(rules.row_rules)
    return cache_of(row_states(df, row_rules, row_key=row_key), row_rules, row_key)
