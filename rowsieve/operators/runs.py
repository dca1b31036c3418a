"""The append-only log of runs: ``run_id, seq, ts, status`` and optional details."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import (
    FIRST_STATUSES,
    NEXT_STATUSES,
    RESTART_STATUSES,
    TERMINAL_STATUSES,
    RunConfig,
)
from rowsieve.operators.groups import PIECE_ROWS, value_before
from rowsieve.operators.validate import tally

SUMMARY_COLUMNS = 50
SUMMARY_ERRORS = 5


def latest_per_run(log: DataFrame) -> DataFrame:
    """The newest log row of each run; combined per task before the shuffle."""
    others = [c for c in log.columns if c != "run_id"]
    newest = F.max_by(F.struct(*others), F.col("seq")).alias("last")
    return log.groupBy("run_id").agg(newest).select("run_id", *[f"last.{c}" for c in others])


def list_runs(log: DataFrame) -> DataFrame:
    """All runs with their current status and start; only the light columns are read."""
    light = [c for c in ("seq", "ts", "status", "file_name") if c in log.columns]
    newest = F.max_by(F.struct(*light), F.col("seq")).alias("last")
    listed = log.groupBy("run_id").agg(newest, F.min("ts").alias("created"))
    return listed.select("run_id", *[f"last.{c}" for c in light], "created")


def run_detail(log: DataFrame, run_id) -> DataFrame:
    """Current state of one run; no row when the run is unknown."""
    return latest_per_run(log.filter(F.col("run_id") == run_id))


def confirm_runs(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(run_id, row_count, status) of the runs in ``asked``: RUNNING with rows, FAILED without.

    Only the run column of ``rows`` is read, counted in each task first.
    """
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("row_count"))
    counted = asked.select("run_id").distinct().join(sizes, "run_id", "left")
    counted = counted.withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))
    status = F.when(F.col("row_count") > 0, F.lit("RUNNING")).otherwise(F.lit("FAILED"))
    return counted.select("run_id", "row_count", status.alias("status"))


def without_runs(state: DataFrame, anew: DataFrame) -> DataFrame:
    """What is left of a state table (ledger, fixes, skips, cache) of many runs when the runs in
    ``anew`` are ingested again: they start with nothing."""
    return state.join(anew.select("run_id").distinct(), "run_id", "left_anti")


def with_transitions(log: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add the previous status, the time spent in it and whether the step is legal."""
    earlier = F.struct(F.col("status").alias("s"), F.col("ts").alias("t"))
    seen = value_before(log, ["run_id"], "seq", earlier, "_before", piece_rows=piece_rows)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    micros_before = F.unix_micros(F.col("_before.t").cast("timestamp"))
    return seen.select(
        *log.columns,
        F.col("_before.s").alias("prev_status"),
        (micros - micros_before).alias("micros_in_prev"),
        _is_legal(F.col("_before.s"), F.col("status")).alias("is_legal"),
    )


def _is_legal(before: Column, after: Column) -> Column:
    legal = F.when(before.isNull(), after.isin(*FIRST_STATUSES))
    legal = legal.when(after.isin(*RESTART_STATUSES), F.lit(True))
    for status, following in NEXT_STATUSES.items():
        legal = legal.when(before == status, after.isin(*following))
    return legal.otherwise(F.lit(False))


def without_stale_idle(log: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Drop IDLE rows that arrive after a run has started and before it has ended."""
    real = F.when(F.col("status") != "IDLE", F.col("status"))
    seen = value_before(
        log, ["run_id"], "seq", real, "_last", skip_nulls=True, piece_rows=piece_rows
    )
    running = F.col("_last").isNotNull() & ~F.col("_last").isin(*TERMINAL_STATUSES)
    return seen.filter(~((F.col("status") == "IDLE") & running)).drop("_last")


def run_summary(
    df: DataFrame,
    ledger: DataFrame,
    pending: DataFrame,
    status: str,
    file_name: str,
    config: RunConfig | None = None,
    artifacts: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row about a run: size, columns, error count, the first queued errors, settings, outputs.

    ``columns`` shows the first 50 names and ``columns_left_out`` how many follow. ``settings`` and
    ``artifacts`` (name to folder) are maps, empty where there is none.
    """
    settings = config.settings if config else {}
    columns = [c for c in df.columns if c != "row_index"]
    counts = tally(
        (df, {"row_count": F.count("*")}),
        (ledger, {"all_errors": F.count("*")}),
        (pending, {"pending_review": F.count("*")}),
    )
    line = F.struct("row_index", "rule_no", "field", "current_value", "error_message")
    first = pending.orderBy("row_index", "rule_no").limit(SUMMARY_ERRORS)
    lines = first.agg(F.sort_array(F.collect_list(line)).alias("first_errors"))
    return counts.select(
        F.lit(status).alias("status"),
        F.lit(file_name).alias("file_name"),
        "row_count",
        F.array(*[F.lit(c) for c in columns[:SUMMARY_COLUMNS]]).alias("columns"),
        F.lit(max(0, len(columns) - SUMMARY_COLUMNS)).cast("long").alias("columns_left_out"),
        "all_errors",
        "pending_review",
        lines.scalar().alias("first_errors"),
        _text_map(settings).alias("settings"),
        _text_map(artifacts or {}).alias("artifacts"),
    )


def _text_map(items: Mapping[str, str]) -> Column:
    cells = [F.lit(text) for pair in items.items() for text in pair]
    return F.create_map(*cells).cast("map<string,string>")
