"""A whole run: validate, review until clean or skipped, enrich, split, write."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.config import REVIEW_BATCH_ROWS, RunConfig
from rowsieve.operators import corrections, incremental, package, validate
from rowsieve.operators.rules import RuleSet, expense_rules
from rowsieve.session import scratch_path, settle
from rowsieve.sources.landing import confirm_rows
from rowsieve.sources.sinks import write_results

# Gets the pass number and the errors still queued (a handful of rows); returns answers, or None
# when nobody replied in time, which skips everything still open.
Reviewer = Callable[[int, DataFrame], DataFrame | None]


@dataclass
class RunReport:
    """What a run did: its status log, number of passes and output sizes."""

    run_id: str
    log: list[tuple[str, int, dt.datetime, str]] = field(default_factory=list)
    passes: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    def enter(self, status: str) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.log.append((self.run_id, len(self.log), now, status))

    @property
    def status(self) -> str:
        return self.log[-1][3]

    def log_rows(self, spark: SparkSession) -> DataFrame:
        schema = "run_id string, seq int, ts timestamp_ntz, status string"
        return spark.createDataFrame(self.log, schema)


def run_review(
    table: DataFrame,
    config: RunConfig,
    reviewer: Reviewer,
    out: str,
    run_id: str,
    rules: RuleSet | None = None,
    max_passes: int | None = None,
) -> RunReport:
    """Take a landed table (dense ``row_index``) to its clean and error sets below ``out``.

    The table is never rewritten: fixes pile up in one small overlay, and each pass refreshes
    the ledger from the rows it touched. Ledger, overlay and skip set are written to the
    shared folder after each pass, so plans stay short and a lost executor costs a re-read.
    When the review is over, table and overlay are put together once for all that follows.
    A queue that is answered in part waits: the reviewer gets the rest of it, and only an empty
    queue is validated again. Passes go on until nothing is open; ``max_passes`` stops a reviewer
    that never helps.
    """
    rules = rules or expense_rules(config)
    report = RunReport(run_id)
    report.enter("INGESTING")
    try:
        report.enter(confirm_rows(table))
        _review(table, config, reviewer, out, rules, max_passes, report)
    except Exception:
        report.enter("FAILED")
        raise
    return report


def _review(
    base: DataFrame,
    config: RunConfig,
    reviewer: Reviewer,
    out: str,
    rules: RuleSet,
    max_passes: int | None,
    report: RunReport,
) -> None:
    spark = base.sparkSession
    work = scratch_path(spark, "review")
    table = base
    skipped = spark.createDataFrame([], "row_index bigint")
    ledger = settle(validate.error_ledger(base, rules), "ledger", f"{work}/ledger/pass_no=1")
    pending = ledger.limit(0)
    fields = [r.field for r in rules.row_rules] + ([rules.unique.field] if rules.unique else [])

    def with_fixes() -> DataFrame:
        """The landed table under all fixes so far, later passes and turns over earlier ones."""
        fixes = spark.read.parquet(f"{work}/fixes")
        order = F.struct("pass_no", "turn", "seq.phase", "seq.seq")
        return corrections.apply_fixes(base, fixes.withColumn("seq", order))

    open_rows_skipped = False
    for pass_no in itertools.count(1):
        if max_passes is not None and pass_no > max_passes:
            pending = ledger
            break
        report.passes = pass_no
        if ledger.isEmpty():
            report.enter("VALIDATING")
            break
        report.enter("WAITING_FOR_USER")
        queue = settle(validate.review_batch(ledger, REVIEW_BATCH_ROWS), "queue")
        left = queue.count()
        before = table
        for turn in itertools.count(1):
            answers = reviewer(pass_no, queue)
            if answers is None or not answers.filter("kind = 'skip_all'").isEmpty():
                open_rows_skipped = True
                break
            changed = settle(
                corrections.answered_cells(answers, base),
                "fixes",
                f"{work}/fixes/pass_no={pass_no}/turn={turn}",
            )
            asked = answers.filter("kind = 'skip'").select("row_index")
            taken = settle(corrections.skippable_rows(asked, ledger), "taken")
            skipped = settle(corrections.add_skips(skipped, taken), "skips")
            table = with_fixes()
            # Wait for the rest of the queue; an answer that takes nothing off it ends the wait.
            touched = changed.select("row_index").union(taken)
            queue = settle(corrections.pop_review(queue, touched), "queue")
            was, left = left, queue.count()
            if left in (0, was):
                break
        report.enter("RUNNING")
        if open_rows_skipped:
            break
        changed = spark.read.parquet(f"{work}/fixes/pass_no={pass_no}").drop("turn")
        ledger = settle(
            incremental.refresh_ledger(before, table, changed, ledger, rules, skipped),
            "ledger",
            f"{work}/ledger/pass_no={pass_no + 1}",
        )

    if table is not base:
        table = settle(table, "table")
    if open_rows_skipped:
        active = corrections.active_error_rows(table, ledger, skipped, fields=fields)
        skipped = settle(corrections.add_skips(skipped, active), "skips")
    history = spark.read.parquet(f"{work}/ledger")
    package.check_ready(report.status, pending, table, ledger, skipped, fields)
    report.enter("PACKAGING")
    success, errors = package.split_rows(table, skipped, history, config)
    report.counts = write_results(success, errors, out, report.run_id)
    report.enter("COMPLETED")
