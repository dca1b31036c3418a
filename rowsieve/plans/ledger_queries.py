"""Queries over the error ledger, the review batch and the incremental pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import EXPENSE_COLUMNS
from rowsieve.functions.fingerprint import with_fingerprint
from rowsieve.operators import incremental, validate
from rowsieve.operators.corrections import accepted_fixes, apply_fixes
from rowsieve.operators.rules import AllowedRule, RuleSet
from rowsieve.plans import twins
from rowsieve.plans.registry import query
from rowsieve.plans.rule_queries import RULES
from rowsieve.session import settle
from rowsieve.sources.tables import expenses

LEDGER = {"ledger": twins.ledger("x")}
BATCH = "SELECT * FROM ledger WHERE row_index IN (SELECT DISTINCT row_index FROM ledger ORDER BY row_index LIMIT 5)"
# A person gave up on the rows with an unreadable amount.
SKIPS = "SELECT row_index FROM x WHERE amount = 'n/a'"


def sample_fixes(x: DataFrame) -> DataFrame:
    """Fixes a person might send, in one scan: good ones, repeats, nulls and bad row numbers."""
    row = F.col("row_index")
    typed = row.cast("string")
    spent = F.col("spend_date")
    iso = F.concat_ws(
        "-", F.substring(spent, 7, 4), F.substring(spent, 1, 2), F.substring(spent, 4, 2)
    )
    padded = F.concat(F.lit("9"), F.lpad(typed, 14, "0"))
    cases = [
        (F.col("dept") == "SALES", typed, "dept", F.lit("HR")),
        (F.col("amount") == "-5", typed, "amount", F.lit("abc")),
        (F.col("amount") == "-5", typed, "amount", F.lit("5")),
        (F.col("currency") == "JPY", F.concat(F.lit(" "), typed), "currency", F.lit("USD")),
        (spent.contains("/"), typed, "spend_date", iso),
        (F.col("vendor") == "", typed, "vendor", F.lit("Vendor UNKNOWN")),
        (F.col("vendor") == "   ", typed, "vendor", F.lit(None).cast("string")),
        (F.col("employee_id").startswith("emp"), typed, "note", F.lit("check id")),
        (F.col("amount") == "n/a", F.concat(F.lit("row "), typed), "dept", F.lit("HR")),
        (F.col("fx_rate") == "abc", padded, "dept", F.lit("HR")),
    ]
    entries = [
        F.when(
            applies,
            F.struct(
                (row * 10 + i).alias("seq"),
                target.alias("row_index"),
                F.lit(field).alias("field"),
                value.alias("new_value"),
            ),
        )
        for i, (applies, target, field, value) in enumerate(cases)
    ]
    return (
        x.select(F.explode(F.array(*entries)).alias("fix"))
        .filter(F.col("fix").isNotNull())
        .select("fix.*")
    )


def fixed_expenses(x: DataFrame) -> DataFrame:
    good = accepted_fixes(sample_fixes(x), x)
    return apply_fixes(x, good, new_fields=["note"])


def sample_skips(x: DataFrame) -> DataFrame:
    return x.filter(F.col("amount") == "n/a").select("row_index")


@query("error_ledger", twins.with_x(**LEDGER) + "SELECT * FROM ledger")
def error_ledger(spark, sf_dir: str) -> DataFrame:
    return validate.error_ledger(expenses(spark, sf_dir), RULES)


@query(
    "error_ledger_with_skips",
    twins.with_x(skips=SKIPS, **LEDGER)
    + "SELECT * FROM ledger WHERE row_index NOT IN (SELECT row_index FROM skips)",
)
def error_ledger_with_skips(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    return validate.error_ledger(x, RULES, skipped=sample_skips(x))


@query(
    "validation_summary",
    twins.with_x(**LEDGER, batch=BATCH)
    + """SELECT (SELECT count(*) FROM x) AS total_rows,
  (SELECT count(*) FROM x) - (SELECT count(DISTINCT row_index) FROM ledger) AS valid_count,
  (SELECT count(DISTINCT row_index) FROM ledger) AS error_count,
  CAST(0 AS BIGINT) AS skipped_unchanged,
  (SELECT count(*) FROM batch) AS pending_review_count,
  (SELECT count(DISTINCT row_index) FROM batch) AS batch_size""",
)
def validation_summary(spark, sf_dir: str) -> DataFrame:
    """The ledger is an output of any pass; the counts read it back."""
    x = expenses(spark, sf_dir)
    ledger = settle(validate.error_ledger(x, RULES), "ledger")
    return validate.validation_summary(x, ledger)


@query("review_batch", twins.with_x(**LEDGER, batch=BATCH) + "SELECT * FROM batch")
def review_batch(spark, sf_dir: str) -> DataFrame:
    ledger = validate.error_ledger(expenses(spark, sf_dir), RULES)
    return validate.review_batch(ledger)


MANY_RULES = 12


@query(
    "review_batch_many_rules",
    twins.with_x()
    + f"""SELECT row_index, r AS rule_no, 'dept' AS field, coalesce(dept, 'None') AS current_value,
  'not allowed by ' || r AS error_message
FROM (SELECT * FROM x WHERE dept <> 'ENG' ORDER BY row_index LIMIT 5), range(1, {MANY_RULES + 1}) t(r)""",
)
def review_batch_many_rules(spark, sf_dir: str) -> DataFrame:
    """Five rows are handed out with all their errors, however many rules there are."""
    rules = RuleSet(
        tuple(
            AllowedRule(i, "dept", ("ENG",), f"not allowed by {i}") for i in range(1, MANY_RULES + 1)
        )
    )
    return validate.review_batch(validate.error_ledger(expenses(spark, sf_dir), rules))


@query(
    "incremental_states_multi_run",
    twins.with_x()
    + """SELECT run_id, state, count(*) AS n FROM (
  SELECT run_id, CASE WHEN run_id = 'a' AND row_index % 2 = 0 AND NOT repeats THEN 'unchanged'
                      ELSE 'checked' END AS state
  FROM (SELECT row_index, row_number() OVER (
          PARTITION BY employee_id, spend_date ORDER BY row_index) > 1 AS repeats FROM x),
       (VALUES ('a'), ('b'), ('c')) AS r(run_id))
GROUP BY run_id, state""",
)
def incremental_states_multi_run(spark, sf_dir: str) -> DataFrame:
    """Three runs hold the same rows; what one has cached says nothing about the others."""
    key = ("run_id", "row_index")
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    x = expenses(spark, sf_dir).withColumn("row_index", F.col("row_index").cast("long"))
    many = x.crossJoin(F.broadcast(runs))  # three rows
    known = with_fingerprint(many.filter("run_id = 'a' AND row_index % 2 = 0"), exclude=key)
    cache = known.select(
        "run_id", "row_fp", F.lit(True).alias("is_valid"), F.lit(RULES.digest()).alias("ruleset_hash")
    ).distinct()
    states = incremental.row_states(many, RULES, cache=cache, row_key=key)
    return states.groupBy("run_id", "state").agg(F.count("*").alias("n"))


@query(
    "errors_by_row",
    twins.with_x(**LEDGER)
    + """SELECT row_index, count(*) AS n_errors,
  string_agg(field, ',' ORDER BY rule_no) AS fields,
  string_agg(error_message, '; ' ORDER BY rule_no) AS messages
FROM ledger GROUP BY row_index""",
)
def errors_by_row(spark, sf_dir: str) -> DataFrame:
    grouped = validate.errors_by_row(validate.error_ledger(expenses(spark, sf_dir), RULES))
    return grouped.select(
        "row_index",
        F.size("errors").cast("long").alias("n_errors"),
        F.array_join("errors.field", ",").alias("fields"),
        F.array_join("errors.error_message", "; ").alias("messages"),
    )


@query(
    "error_row_count",
    twins.with_x(**LEDGER) + "SELECT count(DISTINCT row_index) AS error_rows FROM ledger",
)
def error_row_count(spark, sf_dir: str) -> DataFrame:
    return validate.error_row_count(validate.error_ledger(expenses(spark, sf_dir), RULES))


@query(
    "error_rows_by_field",
    twins.with_x(**LEDGER)
    + """SELECT field, count(DISTINCT row_index) AS error_rows, count(*) AS errors
FROM ledger GROUP BY field""",
)
def error_rows_by_field(spark, sf_dir: str) -> DataFrame:
    return validate.error_rows_by_field(validate.error_ledger(expenses(spark, sf_dir), RULES))


@query(
    "completion_metrics",
    twins.with_x(skips=SKIPS)
    + """SELECT (SELECT count(*) FROM x) AS total_rows,
  (SELECT count(*) FROM x) - (SELECT count(*) FROM skips) AS valid_count,
  (SELECT count(*) FROM skips) AS error_count, CAST(0 AS BIGINT) AS fixed_count""",
)
def completion_metrics(spark, sf_dir: str) -> DataFrame:
    """After a finished run the queue is empty, so the skipped rows are the errors."""
    x = expenses(spark, sf_dir)
    queue = spark.createDataFrame([], "row_index bigint")
    return validate.completion_metrics(x, queue, sample_skips(x))


@query(
    "completion_metrics_waiting",
    twins.with_x(**LEDGER, batch=BATCH)
    + """SELECT (SELECT count(*) FROM x) AS total_rows,
  (SELECT count(*) FROM x) - (SELECT count(*) FROM batch) AS valid_count,
  (SELECT count(*) FROM batch) AS error_count, (SELECT count(*) FROM batch) AS fixed_count""",
)
def completion_metrics_waiting(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    queue = validate.review_batch(validate.error_ledger(x, RULES))
    return validate.completion_metrics(x, queue, sample_skips(x))


@query(
    "outcome_status",
    twins.with_x(**LEDGER)
    + """SELECT CASE WHEN count(*) > 0 THEN 'WAITING_FOR_USER' ELSE 'VALIDATING' END AS status
FROM ledger""",
)
def outcome_status(spark, sf_dir: str) -> DataFrame:
    return validate.outcome_status(validate.error_ledger(expenses(spark, sf_dir), RULES))


@query(
    "row_fingerprint",
    twins.with_x() + f"SELECT row_index, {twins.fingerprint(EXPENSE_COLUMNS)} AS row_fp FROM x",
)
def row_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_fingerprint(expenses(spark, sf_dir)).select("row_index", "row_fp")


FIXED = {"f": twins.GOOD_FIXES, "y": twins.fixed()}
Y_COLUMNS = (*EXPENSE_COLUMNS, "note")


@query(
    "changed_rows",
    twins.with_x(**FIXED)
    + f"""SELECT x.row_index,
  CASE WHEN {twins.fingerprint(EXPENSE_COLUMNS)} = y.fp
       THEN 'same' ELSE 'changed' END AS change
FROM x JOIN (SELECT row_index, {twins.fingerprint(EXPENSE_COLUMNS)} AS fp FROM y) y
  ON x.row_index = y.row_index""",
)
def changed_rows(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    fixed = fixed_expenses(x).drop("note")
    return incremental.changed_rows(x, fixed).select("row_index", "change")


@query(
    "changed_rows_two_sided",
    twins.with_x(
        a="SELECT * FROM x WHERE amount <> '-5'",
        b="SELECT * FROM x WHERE currency <> 'JPY'",
    )
    + """SELECT coalesce(a.row_index, b.row_index) AS row_index,
  CASE WHEN a.row_index IS NULL THEN 'added' WHEN b.row_index IS NULL THEN 'removed'
       ELSE 'same' END AS change
FROM a FULL OUTER JOIN b ON a.row_index = b.row_index""",
)
def changed_rows_two_sided(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    before = x.filter(F.col("amount") != "-5")
    after = x.filter(F.col("currency") != "JPY")
    return incremental.changed_rows(before, after).select("row_index", "change")


def _first_pass_cache(x: DataFrame) -> DataFrame:
    return incremental.cache_of(incremental.row_states(x, RULES), RULES)


# The state of every row in the second pass: after fixes, with the cache of the first pass.
_VALID_X = "SELECT DISTINCT {fp} AS fp FROM x WHERE row_index NOT IN (SELECT row_index FROM ledger)"
SECOND_PASS = {
    **LEDGER,
    **FIXED,
    "skips": SKIPS,
    "y7": "SELECT * EXCLUDE (note) FROM y",
    "cached": _VALID_X.format(fp=twins.fingerprint(EXPENSE_COLUMNS)),
    "y_ledger": twins.ledger("y7"),
    "y_prev": twins.repeats("y7"),
    "states": f"""SELECT y7.row_index, {twins.fingerprint(EXPENSE_COLUMNS)} AS row_fp,
  CASE WHEN y7.row_index IN (SELECT row_index FROM skips) THEN 'user_skipped'
       WHEN ({twins.fingerprint(EXPENSE_COLUMNS)}) IN (SELECT fp FROM cached)
            AND y_prev.prev_row IS NULL THEN 'unchanged'
       ELSE 'checked' END AS state
FROM y7 JOIN y_prev ON y7.row_index = y_prev.row_index""",
}


def _second_pass(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    fixed = fixed_expenses(x).drop("note")
    return incremental.row_states(
        fixed, RULES, skipped=sample_skips(x), cache=_first_pass_cache(x)
    )


@query(
    "incremental_states",
    twins.with_x(**SECOND_PASS) + "SELECT row_index, row_fp, state FROM states",
)
def incremental_states(spark, sf_dir: str) -> DataFrame:
    return _second_pass(spark, sf_dir).select("row_index", "row_fp", "state")


@query(
    "incremental_validate",
    twins.with_x(**SECOND_PASS)
    + """SELECT * FROM y_ledger
WHERE row_index IN (SELECT row_index FROM states WHERE state = 'checked')""",
)
def incremental_validate(spark, sf_dir: str) -> DataFrame:
    return incremental.ledger_of(_second_pass(spark, sf_dir))


@query(
    "incremental_summary",
    twins.with_x(**SECOND_PASS)
    + """SELECT state, count(*) AS n_rows, count_if(valid) AS n_valid FROM (
  SELECT state, state = 'unchanged' OR (state = 'checked'
    AND row_index NOT IN (SELECT row_index FROM y_ledger)) AS valid FROM states)
GROUP BY state""",
)
def incremental_summary(spark, sf_dir: str) -> DataFrame:
    return _second_pass(spark, sf_dir).groupBy("state").agg(
        F.count("*").alias("n_rows"), F.count_if("is_valid").alias("n_valid")
    )


@query(
    "refresh_ledger",
    twins.with_x(**FIXED, again=twins.ledger("y")) + "SELECT * FROM again",
)
def refresh_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger after the fixes, worked out from the old one and the fixed rows."""
    x = expenses(spark, sf_dir)
    good = accepted_fixes(sample_fixes(x), x)
    return incremental.refresh_ledger(
        x, fixed_expenses(x), good, validate.error_ledger(x, RULES), RULES
    )


@query(
    "cache_rewrite",
    twins.with_x(**SECOND_PASS)
    + """SELECT row_fp, arg_max(valid, row_index) AS is_valid FROM (
  SELECT row_fp, row_index, state = 'unchanged' OR (state = 'checked'
    AND row_index NOT IN (SELECT row_index FROM y_ledger)) AS valid FROM states)
GROUP BY row_fp""",
)
def cache_rewrite(spark, sf_dir: str) -> DataFrame:
    cache = incremental.cache_of(_second_pass(spark, sf_dir), RULES)
    return cache.select("row_fp", "is_valid")


@query(
    "cache_invalidate",
    twins.with_x(**{k: v for k, v in SECOND_PASS.items() if k in ("ledger", "f", "skips")})
    + f"""SELECT row_fp, is_valid AND NOT skipped AS is_valid FROM (
  SELECT row_fp, arg_max(row_index NOT IN (SELECT row_index FROM ledger), row_index) AS is_valid,
    bool_or(row_index IN (SELECT row_index FROM f)) AS touched,
    bool_or(row_index IN (SELECT row_index FROM skips)) AS skipped
  FROM (SELECT row_index, {twins.fingerprint(EXPENSE_COLUMNS)} AS row_fp FROM x)
  GROUP BY row_fp) WHERE skipped OR NOT touched""",
)
def cache_invalidate(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    prints = with_fingerprint(x).select("row_index", "row_fp")
    good = accepted_fixes(sample_fixes(x), x)
    kept = incremental.invalidate_cache(
        _first_pass_cache(x),
        RULES,
        fixed=prints.join(good.select("row_index"), "row_index", "left_semi"),
        skipped=prints.join(sample_skips(x), "row_index", "left_semi"),
    )
    return kept.select("row_fp", "is_valid")


@query(
    "cache_invalidate_multi_run",
    twins.with_x(**{k: v for k, v in SECOND_PASS.items() if k in ("ledger", "f", "skips")})
    + f"""SELECT run_id, row_fp, is_valid AND NOT skipped AS is_valid FROM (
  SELECT run_id, row_fp,
    arg_max(row_index NOT IN (SELECT row_index FROM ledger), row_index) AS is_valid,
    run_id = 'a' AND bool_or(row_index IN (SELECT row_index FROM f)) AS touched,
    run_id = 'b' AND bool_or(row_index IN (SELECT row_index FROM skips)) AS skipped
  FROM (SELECT row_index, {twins.fingerprint(EXPENSE_COLUMNS)} AS row_fp FROM x),
    (VALUES ('a'), ('b'), ('c')) AS runs(run_id)
  GROUP BY run_id, row_fp) WHERE skipped OR NOT touched""",
)
def cache_invalidate_multi_run(spark, sf_dir: str) -> DataFrame:
    """Run a fixes rows, run b skips some, run c does nothing: equal rows, caches of their own."""
    key = ("run_id", "row_index")
    x = expenses(spark, sf_dir)
    runs = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    many = x.withColumn("run_id", runs)
    cache = incremental.cache_of(incremental.row_states(many, RULES, row_key=key), RULES, key)
    good = accepted_fixes(sample_fixes(x), x)
    # Only the rows that are fixed or skipped need a fingerprint here.
    fixed = with_fingerprint(x.join(good.select("row_index"), "row_index", "left_semi"))
    skipped = with_fingerprint(x.join(sample_skips(x), "row_index", "left_semi"))
    kept = incremental.invalidate_cache(
        cache,
        RULES,
        fixed=fixed.withColumn("run_id", F.lit("a")),
        skipped=skipped.withColumn("run_id", F.lit("b")),
        row_key=key,
    )
    return kept.select("run_id", "row_fp", "is_valid")
