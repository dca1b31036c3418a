"""Review sessions with an idle timeout, and the current status of every run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowsieve.config import REVIEW_TIMEOUT_SECONDS
from rowsieve.operators import keyed_log
from rowsieve.operators.runs import latest_per_run
from rowsieve.streaming.files import append_available, each_available


def session_windows(
    actions: DataFrame, timeout_seconds: int = REVIEW_TIMEOUT_SECONDS
) -> DataFrame:
    """The built-in form of :func:`rowsieve.operators.corrections.review_sessions`."""
    session = F.session_window("ts", f"{timeout_seconds} seconds")
    return (
        actions.groupBy("run_id", session.alias("session"))
        .agg(F.count("*").alias("n_actions"))
        .select(
            "run_id",
            F.col("session.start").alias("started"),
            F.col("session.end").alias("timed_out"),
            "n_actions",
        )
    )


def timed_out_sessions(
    actions: DataFrame,
    path: str,
    checkpoint: str,
    timeout_seconds: int = REVIEW_TIMEOUT_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Sessions of ``run_id, ts`` that ended in a timeout; their open rows are to be skipped.

    A session is out once the watermark passes its end. The session of
    :func:`rowsieve.session.build_session` merges sessions of one run in each task first.
    """
    sessions = session_windows(actions.withWatermark("ts", lateness), timeout_seconds)
    return append_available(sessions, path, checkpoint)


def auto_skips(
    events: DataFrame,
    path: str,
    checkpoint: str,
    timeout_seconds: int = REVIEW_TIMEOUT_SECONDS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """(run_id, row_index, skipped_at): rows still open when their run's clock ran out.

    ``events`` holds run_id, ts, seq, kind and row_index: ``open`` queues a row, ``answer`` takes
    it (a null row_index: every row) from the queue, and any event restarts the run's clock. State is
    keyed by run: its open rows and the time of its last event. A pause above the timeout skips
    what is open, inside a batch or, once the watermark has passed, by a timer; the run then
    starts anew. A row opened twice is open once. Events of one run and batch are sorted by
    (ts, seq) in one task; deliveries bound their number.
    """
    timeout = timeout_seconds * 1_000_000

    def follow(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, rows = state.get if state.exists else (None, [])
        held = dict.fromkeys(rows or [])
        out: list[tuple] = []

        def skip_open() -> None:
            out.extend((key[0], row, last + timeout) for row in held)
            held.clear()

        if state.hasTimedOut:
            skip_open()
            state.remove()
        else:
            batch = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
            for at, kind, row in zip(batch["at"], batch["kind"], batch["row_index"]):
                at = int(at)
                if last is not None and at - last > timeout:
                    skip_open()
                last = at if last is None else max(last, at)
                if kind == "open":
                    held[int(row)] = None
                elif pd.isna(row):
                    held.clear()
                else:
                    held.pop(int(row), None)
            state.update((last, list(held)))
            # The timer needs whole milliseconds past the watermark; the pause must be longer.
            due = (last + timeout) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "row_index", "at"])

    run_type = dict(events.dtypes)["run_id"]
    row = F.col("row_index").cast("long").alias("row_index")
    watched = events.select(
        "run_id", "ts", F.unix_micros("ts").alias("at"), "seq", "kind", row
    ).withWatermark("ts", lateness)
    skips = watched.groupBy("run_id").applyInPandasWithState(
        follow,
        f"run_id {run_type}, row_index long, at long",
        "last long, rows array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    shown = skips.select("run_id", "row_index", F.timestamp_micros("at").alias("skipped_at"))
    return append_available(shown, path, checkpoint)


def current_status(
    log: DataFrame, path: str, checkpoint: str, compact_every: int = 50
) -> DataFrame:
    """Latest log row per run.

    Each batch writes the runs it changed as a version; every ``compact_every`` batches the
    versions are put together, so a reader sees a row a run and the changes since.
    """
    spark = log.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed_log.append_version(batch, path, batch_id)
        if batch_id and batch_id % compact_every == 0:
            keyed_log.compact(spark, path, ["run_id"], batch_id)

    each_available(latest_per_run(log), handle, checkpoint, mode="update")
    return keyed_log.current_rows(spark, path, ["run_id"])


def open_rows_to_skip(sessions: DataFrame, open_rows: DataFrame) -> DataFrame:
    """Rows ``(run_id, row_index)`` still open in runs whose session timed out."""
    timed_out = sessions.groupBy("run_id").agg(F.max("timed_out").alias("timed_out"))
    return open_rows.join(timed_out, "run_id").select("run_id", "row_index")
