"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, leave ``master`` unset and let spark-submit supply sizes; AQE then
    picks the shuffle widths and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Recording the Python call site of every column costs more than building it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Merge session windows before the shuffle so one busy run stays small.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@functools.cache
def _local_folder() -> str:
    """One temporary folder for this process; the session's settings stay as they are."""
    return tempfile.mkdtemp(prefix="rowsieve-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder given in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # local-cluster has executors of its own, so it needs the shared folder too.
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/rowsieve/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond its files, so a lost executor costs one
    re-read and a loop of passes does not grow its plan.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
