"""Cell fixes, row fixes and skips, applied as overlays.

Fixes are rows ``(seq, row_index, field, new_value)``; the table itself is never updated
in place. ``row_index`` may arrive as text typed by a person and is guarded first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.config import REVIEW_TIMEOUT_SECONDS
from rowsieve.functions.text import render, shown
from rowsieve.operators.groups import PIECE_ROWS, value_before
from rowsieve.operators.validate import ROW_KEY, tally

# --- fixed values -----------------------------------------------------------
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*\z"
NOT_INTEGER_TEXT = "Invalid row_index: {value}. Must be an integer."
OUT_OF_RANGE_TEXT = "Row index {value} out of range."
EMPTY_MAP_TEXT = "fixes must be a non-empty dict of field->value."
REVALIDATE = "REVALIDATE"
WAIT = "WAIT_FOR_MORE_FIXES"
# --- end of fixed values ----------------------------------------------------


def _row_number(cell: Column) -> Column:
    text = cell.cast("string")
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def with_fix_problem(
    fixes: DataFrame, table: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Add ``problem``: why a fix cannot be applied, or null. Row indices run 0..n-1 in a run.

    With scope columns in front of the index (a run), each run's own rows bound its fixes; a run
    without rows takes none.
    """
    *scope, index = row_key
    row = _row_number(F.col(index))
    typed = shown(F.col(index))
    problem = F.when(row.isNull(), render(NOT_INTEGER_TEXT, value=typed))
    if "fixes" in fixes.columns:
        empty = F.coalesce(F.size("fixes") < 1, F.lit(True))
        problem = problem.when(empty, F.lit(EMPTY_MAP_TEXT))
    bounded = fixes
    if scope:
        # One row a run, counted in each task first.
        sizes = table.groupBy(*scope).agg(F.count("*").alias("_n_rows"))
        bounded = fixes.join(sizes, scope, "left")
        n_rows = F.coalesce(F.col("_n_rows"), F.lit(0))
    else:
        n_rows = table.select(F.count("*")).scalar()
    problem = problem.when(
        (row < 0) | (row >= n_rows), render(OUT_OF_RANGE_TEXT, value=row.cast("string"))
    )
    return bounded.withColumn("problem", problem).select(*fixes.columns, "problem")


def accepted_fixes(
    fixes: DataFrame, table: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Fixes that can be applied, with a whole-number row index."""
    checked = with_fix_problem(fixes, table, row_key)
    usable = checked.filter(F.col("problem").isNull()).drop("problem")
    return usable.withColumn(row_key[-1], _row_number(F.col(row_key[-1])))


def rejected_fixes(
    fixes: DataFrame, table: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Fixes that cannot be applied, with the reason in ``problem``."""
    return with_fix_problem(fixes, table, row_key).filter(F.col("problem").isNotNull())


def expand_row_fixes(row_fixes: DataFrame) -> DataFrame:
    """Row fixes ``(…, fixes map)`` as cell fixes."""
    others = [c for c in row_fixes.columns if c != "fixes"]
    return row_fixes.select(*others, F.explode("fixes").alias("field", "new_value"))


def _new_fields(df: DataFrame, fixes: DataFrame) -> list[str]:
    unknown = fixes.filter(~F.col("field").isin(*df.columns)).select("field").distinct()
    return sorted(r["field"] for r in unknown.collect())  # names of new columns, not rows


def apply_fixes(
    df: DataFrame,
    fixes: DataFrame,
    new_fields: Sequence[str] | None = None,
    row_key: Sequence[str] = ROW_KEY,
    order: str = "seq",
) -> DataFrame:
    """Overlay accepted fixes on ``df``; the last fix of a cell wins and may set it to null.

    A field the table lacks becomes a new text column. Fixes collapse to one row per table
    row (combined before the shuffle) and meet the table in one left join.
    """
    key = list(row_key)
    added = list(_new_fields(df, fixes) if new_fields is None else new_fields)
    names = [c for c in df.columns if c not in key] + [c for c in added if c not in df.columns]
    last = [
        F.max_by(
            # The box tells "set to null" from "not fixed".
            F.struct(F.col("new_value").alias("v")),
            F.when(F.col("field") == name, F.col(order)),
        ).alias(f"_fix_{i}")
        for i, name in enumerate(names)
    ]
    overlay = fixes.groupBy(*key).agg(*last)
    types = dict(df.dtypes)
    cells = []
    for i, name in enumerate(names):
        old = F.col(name) if name in types else F.lit(None).cast("string")
        new = F.col(f"_fix_{i}.v").try_cast(types.get(name, "string"))
        cells.append(F.when(F.col(f"_fix_{i}").isNotNull(), new).otherwise(old).alias(name))
    return df.join(overlay, key, "left").select(*key, *cells)


def _pick(fields: Sequence[str], columns: Sequence[str], absent: Column) -> Column:
    """The cell of the column that ``field`` names."""
    cell = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in fields:
        if name in columns:
            cell = cell.when(F.col("field") == name, F.col(name).cast("string"))
    return cell.when(~F.col("field").isin(*columns), absent)


def fix_audit(
    df: DataFrame,
    fixes: DataFrame,
    row_key: Sequence[str] = ROW_KEY,
    order: str = "seq",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Old and new value of every accepted fix; a second fix of a cell sees the first.

    ``order`` is a whole number, unique per cell.
    """
    key = list(row_key)
    boxed = F.struct(F.col("new_value").alias("text"))
    chained = value_before(
        fixes.select(*key, order, "field", "new_value"),
        [*key, "field"],
        order,
        boxed,
        "_earlier",
        piece_rows=piece_rows,
    )
    columns = [c for c in df.columns if c not in key]
    # Of the table only the columns that some fix names are read and moved.
    named = fixes.filter(F.col("field").isin(columns)).select("field").distinct().collect()
    fixed = sorted(r["field"] for r in named)
    original = _pick(fixed, columns, F.lit(None).cast("string"))
    old = F.when(F.col("_earlier").isNotNull(), F.col("_earlier.text")).otherwise(original)
    return chained.join(df.select(*key, *fixed), key, "inner").select(
        order, *key, "field", old.alias("old_value"), "new_value"
    )


def pop_review(
    batch: DataFrame, touched: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """The queue without the errors of touched rows, whether or not they are all repaired."""
    return batch.join(touched.select(*row_key), list(row_key), "left_anti")


def review_action(pending: DataFrame) -> DataFrame:
    """What follows a pop: re-validate when the queue is empty, else wait."""
    left = pending.agg(F.count("*").alias("remaining_fixes"))
    action = F.when(F.col("remaining_fixes") == 0, F.lit(REVALIDATE)).otherwise(F.lit(WAIT))
    return left.withColumn("action", action)


def skippable_rows(
    requested: DataFrame, ledger: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """Requests to skip a row that has ledger errors; the others have no effect."""
    *scope, index = row_key
    typed = requested.withColumn(index, _row_number(F.col(index)))
    return typed.join(ledger.select(*row_key), list(row_key), "left_semi")


def add_skips(
    skipped: DataFrame, more: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """The union of two skip sets."""
    return skipped.select(*row_key).union(more.select(*row_key)).distinct()


def active_error_rows(
    df: DataFrame,
    ledger: DataFrame,
    skipped: DataFrame | None = None,
    row_key: Sequence[str] = ROW_KEY,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with an error whose cell still shows the text it had when it was reported.

    ``fields`` names the columns ledger errors can be on; only these are read.
    """
    key = list(row_key)
    columns = [c for c in df.columns if c not in key]
    fields = [c for c in columns if fields is None or c in fields]
    now = shown(_pick(fields, columns, F.lit("")))
    open_errors = ledger
    if skipped is not None:
        open_errors = ledger.join(skipped.select(*key), key, "left_anti")
    current = df.select(*key, *fields)
    return (
        open_errors.select(*key, "field", "current_value")
        .join(current, key, "inner")
        .filter(now == F.col("current_value"))
        .select(*key)
        .distinct()
    )


@dataclass(frozen=True)
class AnswerResult:
    """The state after one set of answers, plus a one-row summary."""

    table: DataFrame
    skipped: DataFrame
    pending: DataFrame
    counts: DataFrame


# Phases run in this order; within one, answers run by seq.
ANSWER_PHASES = {"fix": 1, "row_fix": 2, "skip": 3}


def apply_answers(
    df: DataFrame,
    ledger: DataFrame,
    pending: DataFrame,
    skipped: DataFrame,
    answers: DataFrame,
    new_fields: Sequence[str] | None = None,
    row_key: Sequence[str] = ROW_KEY,
    fields: Sequence[str] | None = None,
) -> AnswerResult:
    """Apply a set of answers: ``skip_all`` alone, else fixes, then row fixes, then skips.

    ``answers`` has columns ``seq, kind, row_index, field, new_value, fixes`` with kind
    ``fix``, ``row_fix``, ``skip`` or ``skip_all``. With scope columns in front of the index in
    ``row_key`` all tables hold many runs, and every run gets the answers that carry its key: one
    run's skip_all leaves the others' answers alone. Nothing is looked at beforehand, so the
    upstream plan runs once. ``fields`` names the columns ledger errors can be on.
    """
    key = list(row_key)
    scope = key[:-1]
    whole = answers.filter(F.col("kind") == "skip_all").select(*scope, F.lit(True).alias("_all"))
    single = _of_runs(answers.filter(F.col("kind") != "skip_all"), whole, scope, False)

    active = active_error_rows(
        _of_runs(df, whole, scope, True), ledger, skipped, key, fields
    )
    applied = answered_cells(single, df, key)
    wanted = single.filter(F.col("kind") == "skip").select(*key)
    taken = skippable_rows(wanted, ledger, key)
    touched = applied.select(*key).union(taken.select(*key))
    # A skip_all that skips anything empties its run's queue; one that skips nothing leaves it.
    left = _of_runs(pop_review(pending, touched, key), active, scope, False)
    skips = add_skips(taken, active, key)
    return AnswerResult(
        apply_fixes(df, applied, new_fields, key),
        add_skips(skipped, skips, key),
        left,
        _answer_counts(applied, taken.select(*key).union(active), left, scope),
    )


def _of_runs(df: DataFrame, runs: DataFrame, scope: Sequence[str], inside: bool) -> DataFrame:
    """Rows of the runs that occur in ``runs`` or, if not ``inside``, of the others."""
    if scope:
        return df.join(runs.select(*scope).distinct(), list(scope), "left_semi" if inside else "left_anti")
    some = runs.select(F.count("*") > 0).scalar()
    return df.filter(some if inside else ~some)


def answered_cells(
    answers: DataFrame, df: DataFrame, row_key: Sequence[str] = ROW_KEY
) -> DataFrame:
    """The cell changes of an answer set; ``seq`` is (phase, seq), in the order they apply."""
    cell_fixes = answers.filter(F.col("kind") == "fix").drop("fixes", "kind")
    row_fixes = answers.filter(F.col("kind") == "row_fix").drop("field", "new_value", "kind")
    cells = accepted_fixes(cell_fixes, df, row_key).select(
        _answer_order("fix"), *row_key, "field", "new_value"
    )
    rows = expand_row_fixes(accepted_fixes(row_fixes, df, row_key)).select(
        _answer_order("row_fix"), *row_key, "field", "new_value"
    )
    return cells.union(rows)


def _answer_order(kind: str) -> Column:
    return F.struct(F.lit(ANSWER_PHASES[kind]).alias("phase"), F.col("seq")).alias("seq")


def _answer_counts(
    applied: DataFrame, skipped: DataFrame, pending: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Applied cells, skipped rows and what is left in the queue: one row, or one a run."""
    parts = {"applied_count": applied, "skipped_count": skipped, "pending_count": pending}
    if not scope:
        return tally(*[(df, {name: F.count("*")}) for name, df in parts.items()])
    counted = None
    for name, df in parts.items():
        ones = [F.lit(int(other == name)).alias(other) for other in parts]
        rows = df.select(*scope, *ones)
        counted = rows if counted is None else counted.unionByName(rows)
    return counted.groupBy(*scope).agg(*[F.sum(name).alias(name) for name in parts])


def idle_runs(
    actions: DataFrame, now: str, timeout_seconds: int = REVIEW_TIMEOUT_SECONDS
) -> DataFrame:
    """Runs whose last action (``run_id, ts``) lies at least the timeout before ``now``."""
    last = actions.groupBy("run_id").agg(F.max("ts").alias("last_action"))
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    return last.filter(F.col("last_action").cast("timestamp_ntz") <= limit)


def review_sessions(
    actions: DataFrame,
    timeout_seconds: int = REVIEW_TIMEOUT_SECONDS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Stretches of actions of a run with no pause above the timeout; each ends in an auto-skip.

    ``actions`` holds ``run_id, ts``. A busy run is cut into pieces of ``piece_rows``, and
    counting is combined per task, so no task holds a whole run.
    """
    pieces = {"piece_rows": piece_rows, "rows": actions.count()}
    timeout = timeout_seconds * 1_000_000
    rows = actions.select("run_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    seen = value_before(rows, ["run_id"], "at", F.col("at"), "before", **pieces)
    opens = F.col("before").isNull() | (F.col("at") - F.col("before") > timeout)
    start = F.when(opens, F.col("at"))
    marked = value_before(
        seen, ["run_id"], "at", start, "opened", skip_nulls=True, **pieces
    ).withColumn("opened", F.coalesce(start, "opened"))
    return (
        marked.groupBy("run_id", "opened")
        .agg(F.max("at").alias("last_at"), F.count("*").alias("n_actions"))
        .select(
            "run_id",
            F.timestamp_micros("opened").alias("started"),
            F.timestamp_micros(F.col("last_at") + timeout).alias("timed_out"),
            "n_actions",
        )
    )
