"""The fingerprint cache as a log of versions with removals (see :mod:`keyed_log`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.operators import keyed_log
from rowsieve.operators.validate import ROW_KEY


def _key(row_key: Sequence[str]) -> list[str]:
    return [*row_key[:-1], "ruleset_hash", "row_fp"]


def append_version(
    entries: DataFrame, path: str, version: int, row_key: Sequence[str] = ROW_KEY
) -> None:
    """Write the entries of one version: (scope, ruleset_hash, row_fp, is_valid[, is_removed])."""
    removed = F.col("is_removed") if "is_removed" in entries.columns else F.lit(False)
    rows = entries.withColumn("is_removed", removed)
    keyed_log.append_version(rows.select(*_key(row_key), "is_valid", "is_removed"), path, version)


def removals(fixed: DataFrame, digest: str, row_key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Entries that take the fingerprints (scope, row_fp) of fixed rows out of the cache."""
    return fixed.select(*row_key[:-1], "row_fp").distinct().withColumns(
        {"ruleset_hash": F.lit(digest), "is_valid": F.lit(False), "is_removed": F.lit(True)}
    )


def current_cache(
    spark: SparkSession, path: str, before: int | None = None, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """The entries in force, those of versions below ``before`` if given; an entry's last one counts."""
    entries = keyed_log.current_rows(spark, path, _key(row_key), before).filter("NOT is_removed")
    return entries.select(*row_key[:-1], "row_fp", "is_valid", "ruleset_hash")


def compact(spark: SparkSession, path: str, version: int, row_key: Sequence[str] = ROW_KEY) -> None:
    """Put all versions up to ``version`` together; removed entries go."""
    keyed_log.compact(spark, path, _key(row_key), version, "NOT is_removed")
