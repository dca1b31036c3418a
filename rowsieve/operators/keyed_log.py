"""A table of current rows by key, kept as versions: appended, replayed, put together.

Below a folder, ``part=log/version=n`` holds the rows that version n wrote and
``part=base/version=n`` everything up to n put together. A version is written whole and may be
written again, by a batch that is replayed, with the same result. A base counts once its write
has been committed; readers use the log until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_version(rows: DataFrame, path: str, version: int) -> None:
    """Write the rows of one version, one for each key it changes."""
    rows.write.mode("overwrite").parquet(f"{path}/part=log/version={version}")


def current_rows(
    spark: SparkSession, path: str, key: Sequence[str], before: int | None = None
) -> DataFrame:
    """The last row of each key, of versions below ``before`` if given.

    Reads the latest base and the versions after it, folders picked by name: work follows the
    keys and what has changed since the base, not all changes ever made. Versions of a key are
    combined in each task before the shuffle.
    """
    log = spark.read.parquet(path)
    if before is not None:
        log = log.filter(F.col("version") < before)
    base = log.filter("part = 'base'").agg(F.max("version")).first()[0]
    if base is None:
        log = log.filter("part = 'log'")
    else:
        newer = (F.col("part") == "log") & (F.col("version") > base)
        log = log.filter(newer | ((F.col("part") == "base") & (F.col("version") == base)))
    others = [c for c in log.columns if c not in (*key, "part", "version")]
    last = F.max_by(F.struct(*others), F.col("version")).alias("last")
    return log.groupBy(*key).agg(last).select(*key, "last.*")


def compact(
    spark: SparkSession, path: str, key: Sequence[str], version: int, kept: str | None = None
) -> None:
    """Put versions up to ``version`` together, clustered by key; rows failing ``kept`` go."""
    rows = current_rows(spark, path, key, version + 1)
    rows = rows.filter(kept) if kept else rows
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    dealt.write.mode("overwrite").parquet(f"{path}/part=base/version={version}")
