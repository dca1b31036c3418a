"""Queries over fixes, skips, answers, the split and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import RunConfig
from rowsieve.operators import corrections, package, runs, validate
from rowsieve.plans import twins
from rowsieve.plans.ledger_queries import (
    BATCH,
    FIXED,
    LEDGER,
    SKIPS,
    fixed_expenses,
    sample_fixes,
    sample_skips,
)
from rowsieve.plans.registry import query
from rowsieve.plans.rule_queries import RULES
from rowsieve.plans.transform_queries import ENRICHED
from rowsieve.plans.workflow import run_review
from rowsieve.session import scratch_path, settle
from rowsieve.sources.tables import EXPENSE_AS_OF, expenses, table

CONFIG = RunConfig(as_of=EXPENSE_AS_OF)
RULE_FIELDS = tuple(r.field for r in RULES.row_rules)


@query("apply_fixes", twins.with_x(**FIXED) + "SELECT * FROM y")
def apply_fixes(spark, sf_dir: str) -> DataFrame:
    return fixed_expenses(expenses(spark, sf_dir))


@query(
    "fix_audit",
    twins.with_x(f=twins.GOOD_FIXES)
    + """SELECT f.seq, f.row_index, f.field,
  CASE WHEN earlier IS NOT NULL THEN earlier ELSE CASE f.field WHEN 'dept' THEN dept
    WHEN 'amount' THEN amount WHEN 'currency' THEN currency WHEN 'spend_date' THEN spend_date
    WHEN 'vendor' THEN vendor END END AS old_value, f.new_value
FROM (SELECT *, lag(new_value) OVER (PARTITION BY row_index, field ORDER BY seq) AS earlier
      FROM f) f JOIN x ON x.row_index = f.row_index""",
)
def fix_audit(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    good = corrections.accepted_fixes(sample_fixes(x), x)
    return corrections.fix_audit(x, good)


@query(
    "rejected_fixes",
    twins.with_x(f=twins.FIXES)
    + """SELECT seq, row_index, CASE WHEN row_index LIKE 'row %'
  THEN 'Invalid row_index: ' || row_index || '. Must be an integer.'
  ELSE 'Row index ' || row_index || ' out of range.' END AS problem
FROM f WHERE row_index LIKE 'row %' OR length(row_index) >= 15""",
)
def rejected_fixes(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    rejected = corrections.rejected_fixes(sample_fixes(x), x)
    return rejected.select("seq", "row_index", "problem")


ROW_FIXES = "SELECT row_index FROM x WHERE fx_rate = 'abc' AND currency <> 'USD'"


@query(
    "apply_row_fixes",
    twins.with_x(r=ROW_FIXES)
    + """SELECT row_index,
  CASE WHEN row_index IN (SELECT row_index FROM r) THEN 'USD' ELSE currency END AS currency,
  CASE WHEN row_index IN (SELECT row_index FROM r) THEN '1.0' ELSE fx_rate END AS fx_rate
FROM x""",
)
def apply_row_fixes(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    row_fixes = x.filter("fx_rate = 'abc' AND currency <> 'USD'").select(
        F.col("row_index").alias("seq"),
        "row_index",
        F.create_map(
            F.lit("currency"), F.lit("USD"), F.lit("fx_rate"), F.lit("1.0")
        ).alias("fixes"),
    )
    cells = corrections.expand_row_fixes(corrections.accepted_fixes(row_fixes, x))
    fixed = corrections.apply_fixes(x, cells, new_fields=[])
    return fixed.select("row_index", "currency", "fx_rate")


@query(
    "rejected_row_fixes",
    twins.with_x()
    + """SELECT row_index, 'fixes must be a non-empty dict of field->value.' AS problem
FROM x WHERE vendor IS NULL""",
)
def rejected_row_fixes(spark, sf_dir: str) -> DataFrame:
    """A row fix with an empty map is refused."""
    x = expenses(spark, sf_dir)
    empty = F.when(F.col("vendor").isNull(), F.expr("CAST(map() AS map<string,string>)"))
    full = F.create_map(F.lit("vendor"), F.lit("Vendor"))
    row_fixes = x.select("row_index", F.coalesce(empty, full).alias("fixes"))
    return corrections.rejected_fixes(row_fixes, x).select("row_index", "problem")


@query(
    "pop_review",
    twins.with_x(**LEDGER, batch=BATCH, f=twins.GOOD_FIXES)
    + "SELECT * FROM batch WHERE row_index NOT IN (SELECT row_index FROM f)",
)
def pop_review(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    batch = validate.review_batch(validate.error_ledger(x, RULES))
    good = corrections.accepted_fixes(sample_fixes(x), x)
    return corrections.pop_review(batch, good)


@query(
    "review_action",
    twins.with_x(**LEDGER, batch=BATCH, f=twins.GOOD_FIXES)
    + """SELECT count(*) AS remaining_fixes, CASE WHEN count(*) = 0 THEN 'REVALIDATE'
  ELSE 'WAIT_FOR_MORE_FIXES' END AS action
FROM batch WHERE row_index NOT IN (SELECT row_index FROM f)""",
)
def review_action(spark, sf_dir: str) -> DataFrame:
    return corrections.review_action(pop_review(spark, sf_dir))


@query(
    "skip_rows",
    twins.with_x(**LEDGER, skips=SKIPS)
    + """SELECT row_index FROM skips UNION
SELECT row_index FROM x
WHERE currency IN ('JPY', 'USD') AND row_index IN (SELECT row_index FROM ledger)""",
)
def skip_rows(spark, sf_dir: str) -> DataFrame:
    """Requests for clean rows have no effect; the others join the earlier skips."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    wanted = x.filter(F.col("currency").isin("JPY", "USD")).select("row_index")
    taken = corrections.skippable_rows(wanted, ledger)
    return corrections.add_skips(sample_skips(x), taken)


CELL_NOW = """coalesce(CASE l.field WHEN 'employee_id' THEN y.employee_id WHEN 'dept' THEN y.dept
  WHEN 'amount' THEN y.amount WHEN 'currency' THEN y.currency
  WHEN 'spend_date' THEN y.spend_date WHEN 'vendor' THEN y.vendor
  WHEN 'fx_rate' THEN y.fx_rate END, 'None')"""
ACTIVE = f"""SELECT DISTINCT l.row_index FROM ledger l JOIN y ON l.row_index = y.row_index
WHERE {CELL_NOW} = l.current_value AND l.row_index NOT IN (SELECT row_index FROM skips)"""


@query(
    "skip_all_active",
    twins.with_x(**LEDGER, **FIXED, skips=SKIPS) + ACTIVE,
)
def skip_all_active(spark, sf_dir: str) -> DataFrame:
    """Rows still showing a reported cell after the sample fixes."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    return corrections.active_error_rows(
        fixed_expenses(x), ledger, sample_skips(x), fields=RULE_FIELDS
    )


def sample_answers(x: DataFrame) -> DataFrame:
    """Cell fixes, row fixes and skips in one table."""
    no_map = F.lit(None).cast("map<string,string>").alias("fixes")
    no_text = F.lit(None).cast("string")
    cells = sample_fixes(x).select(
        "seq", F.lit("fix").alias("kind"), "row_index", "field", "new_value", no_map
    )
    rows = x.filter("fx_rate = 'abc' AND currency <> 'USD'").select(
        F.col("row_index").alias("seq"),
        F.lit("row_fix").alias("kind"),
        F.col("row_index").cast("string"),
        no_text.alias("field"),
        no_text.alias("new_value"),
        F.create_map(
            F.lit("currency"), F.lit("USD"), F.lit("fx_rate"), F.lit("1.0")
        ).alias("fixes"),
    )
    skips = x.filter("currency = 'USD'").select(
        F.col("row_index").alias("seq"),
        F.lit("skip").alias("kind"),
        F.col("row_index").cast("string"),
        no_text.alias("field"),
        no_text.alias("new_value"),
        no_map,
    )
    return cells.union(rows).union(skips)


def _answered(spark, sf_dir: str) -> corrections.AnswerResult:
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    return corrections.apply_answers(
        x,
        ledger,
        validate.review_batch(ledger),
        sample_skips(x),
        sample_answers(x),
        new_fields=["note"],
    )


# Row fixes come after cell fixes, so they win.
ANSWERED = {
    "r": ROW_FIXES,
    "z": """SELECT * REPLACE (
  CASE WHEN row_index IN (SELECT row_index FROM r) THEN 'USD' ELSE currency END AS currency,
  CASE WHEN row_index IN (SELECT row_index FROM r) THEN '1.0' ELSE fx_rate END AS fx_rate)
FROM y""",
    "taken": """SELECT row_index FROM x WHERE currency = 'USD'
  AND row_index IN (SELECT row_index FROM ledger)""",
}


@query("apply_answers", twins.with_x(**LEDGER, **FIXED, **ANSWERED) + "SELECT * FROM z")
def apply_answers(spark, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).table


@query(
    "answer_counts",
    twins.with_x(**LEDGER, **FIXED, **ANSWERED, batch=BATCH)
    + """SELECT (SELECT count(*) FROM f) + 2 * (SELECT count(*) FROM r) AS applied_count,
  (SELECT count(*) FROM taken) AS skipped_count,
  (SELECT count(*) FROM batch WHERE row_index NOT IN (SELECT row_index FROM f)
    AND row_index NOT IN (SELECT row_index FROM r)
    AND row_index NOT IN (SELECT row_index FROM taken)) AS pending_count""",
)
def answer_counts(spark, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).counts


@query(
    "answer_skips",
    twins.with_x(**LEDGER, taken=ANSWERED["taken"], skips=SKIPS)
    + "SELECT row_index FROM skips UNION SELECT row_index FROM taken",
)
def answer_skips(spark, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).skipped


@query(
    "answer_skip_all",
    twins.with_x(**LEDGER, skips=SKIPS)
    + "SELECT row_index FROM skips UNION SELECT row_index FROM ledger",
)
def answer_skip_all(spark, sf_dir: str) -> DataFrame:
    """skip_all wins over every other answer of the set."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    answers = sample_answers(x).withColumn(
        "kind", F.when(F.col("kind") == "skip", "skip_all").otherwise(F.col("kind"))
    )
    queue = validate.review_batch(ledger)
    return corrections.apply_answers(x, ledger, queue, sample_skips(x), answers).skipped


def _many_runs(spark, sf_dir: str) -> corrections.AnswerResult:
    """Three runs over the same rows: a is answered cell by cell, b skips all, c gets no answer."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)

    def in_runs(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumn("run_id", F.explode(F.array(*map(F.lit, names))))

    kind = F.when(F.col("kind") == "skip", "skip_all").otherwise(F.col("kind"))
    answers = in_runs(sample_answers(x), "a").unionByName(
        in_runs(sample_answers(x).withColumn("kind", kind), "b")
    )
    return corrections.apply_answers(
        in_runs(x, "a", "b", "c"),
        in_runs(ledger, "a", "b", "c"),
        in_runs(validate.review_batch(ledger), "a", "b", "c"),
        in_runs(sample_skips(x), "a", "b"),
        answers,
        new_fields=["note"],
        row_key=("run_id", "row_index"),
        fields=RULE_FIELDS,
    )


@query(
    "apply_answers_multi_run",
    twins.with_x(**LEDGER, **FIXED, **ANSWERED)
    + """SELECT 'a' AS run_id, * FROM z
UNION ALL SELECT run_id, x.*, NULL AS note FROM (VALUES ('b'), ('c')) AS runs(run_id), x""",
)
def apply_answers_multi_run(spark, sf_dir: str) -> DataFrame:
    return _many_runs(spark, sf_dir).table


@query(
    "answer_skips_multi_run",
    twins.with_x(**LEDGER, taken=ANSWERED["taken"], skips=SKIPS)
    + """SELECT 'a' AS run_id, row_index FROM (SELECT row_index FROM skips UNION SELECT row_index FROM taken)
UNION ALL SELECT 'b', row_index FROM (SELECT row_index FROM skips UNION SELECT row_index FROM ledger)""",
)
def answer_skips_multi_run(spark, sf_dir: str) -> DataFrame:
    return _many_runs(spark, sf_dir).skipped


@query(
    "rejected_fixes_multi_run",
    """WITH sizes AS (SELECT o_orderstatus AS run_id, count(*) AS n FROM orders GROUP BY 1),
asked AS (SELECT o_orderstatus AS run_id, o_orderkey AS seq, o_orderkey AS row_index FROM orders
  UNION ALL SELECT 'none', o_orderkey, 0 FROM orders WHERE o_orderkey < 3)
SELECT asked.run_id, seq, 'Row index ' || row_index || ' out of range.' AS problem
FROM asked LEFT JOIN sizes ON asked.run_id = sizes.run_id WHERE row_index >= coalesce(n, 0)""",
)
def rejected_fixes_multi_run(spark, sf_dir: str) -> DataFrame:
    """Each run's own rows bound its fixes; a run that has none takes none."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderkey").alias("row_index"))
    asked = rows.withColumn("seq", F.col("row_index")).unionByName(
        rows.filter("row_index < 3").select(
            F.lit("none").alias("run_id"), F.lit(0).cast("long").alias("row_index"), F.col("row_index").alias("seq")
        )
    )
    refused = corrections.rejected_fixes(asked, rows, ("run_id", "row_index"))
    return refused.select("run_id", "seq", "problem")


NOW = "2024-01-30 12:00:00"


def actions(spark, sf_dir: str) -> DataFrame:
    """The event table read as a log of review actions: a user is a run."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts")


@query(
    "timeout_runs",
    f"""SELECT user_id AS run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_action
FROM events GROUP BY user_id
HAVING max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND""",
)
def timeout_runs(spark, sf_dir: str) -> DataFrame:
    idle = corrections.idle_runs(actions(spark, sf_dir), NOW)
    shown = F.date_format("last_action", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return idle.select("run_id", shown.alias("last_action"))


SESSIONS = """SELECT user_id AS run_id, epoch_us(min(ts)) AS started_us,
  epoch_us(max(ts)) + 300000000 AS timed_out_us, count(*) AS n_actions
FROM (SELECT user_id, ts, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS no
      FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL
              OR ts - lag(ts) OVER w > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS is_new
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)))
GROUP BY user_id, no"""


def session_rows(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "run_id",
        F.unix_micros("started").alias("started_us"),
        F.unix_micros("timed_out").alias("timed_out_us"),
        "n_actions",
    )


@query("review_sessions", SESSIONS)
def review_sessions(spark, sf_dir: str) -> DataFrame:
    return session_rows(corrections.review_sessions(actions(spark, sf_dir)))


@query("review_sessions_hot", SESSIONS)
def review_sessions_hot(spark, sf_dir: str) -> DataFrame:
    """The same in pieces of 20 actions, so every run above that is cut."""
    return session_rows(
        corrections.review_sessions(actions(spark, sf_dir), piece_rows=20)
    )


@query(
    "timeout_skips",
    twins.with_x(
        **LEDGER,
        skips=SKIPS,
        idle=f"""SELECT user_id FROM events GROUP BY user_id
HAVING max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 300 SECOND""",
    )
    + """SELECT o_custkey AS run_id, l.row_index FROM (SELECT DISTINCT row_index FROM ledger) l
JOIN orders ON o_orderkey = l.row_index JOIN idle ON user_id = o_custkey
WHERE l.row_index NOT IN (SELECT row_index FROM skips)""",
)
def timeout_skips(spark, sf_dir: str) -> DataFrame:
    """Many runs in one job: each customer's expenses are a run; idle runs skip what is open."""
    x = expenses(spark, sf_dir)
    owner = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"), F.col("o_custkey").alias("run_id")
    )
    active = corrections.active_error_rows(
        x, validate.error_ledger(x, RULES), sample_skips(x), fields=RULE_FIELDS
    )
    idle = corrections.idle_runs(actions(spark, sf_dir), NOW).select("run_id")
    return active.join(owner, "row_index").join(idle, "run_id").select("run_id", "row_index")


# --- after the fixes --------------------------------------------------------


@query(
    "revalidate_after_fixes",
    twins.with_x(**FIXED, again=twins.ledger("y")) + "SELECT * FROM again",
)
def revalidate_after_fixes(spark, sf_dir: str) -> DataFrame:
    return validate.error_ledger(fixed_expenses(expenses(spark, sf_dir)), RULES)


@query(
    "success_rows",
    twins.with_x(e=ENRICHED, skips=SKIPS)
    + "SELECT * FROM e WHERE row_index NOT IN (SELECT row_index FROM skips)",
)
def success_rows(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    return package.split_rows(x, sample_skips(x), ledger, CONFIG)[0]


@query(
    "error_rows",
    twins.with_x(e=ENRICHED, skips=SKIPS, **LEDGER)
    + """SELECT e.*, coalesce(r.reason, '') AS error_reason FROM e
LEFT JOIN (SELECT row_index, string_agg(error_message, '; ' ORDER BY rule_no) AS reason
           FROM ledger GROUP BY row_index) r ON e.row_index = r.row_index
WHERE e.row_index IN (SELECT row_index FROM skips)""",
)
def error_rows(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    return package.split_rows(x, sample_skips(x), ledger, CONFIG)[1]


@query(
    "error_reasons_two_passes",
    twins.with_x(**LEDGER, **FIXED, again=twins.ledger("y"), skips=SKIPS)
    + """SELECT row_index, coalesce(
  (SELECT string_agg(error_message, '; ' ORDER BY rule_no) FROM again a
   WHERE a.row_index = s.row_index),
  (SELECT string_agg(error_message, '; ' ORDER BY rule_no) FROM ledger l
   WHERE l.row_index = s.row_index)) AS error_reason FROM skips s""",
)
def error_reasons_two_passes(spark, sf_dir: str) -> DataFrame:
    """The reason of a skipped row comes from its latest pass that found errors."""
    x = expenses(spark, sf_dir)
    first = validate.error_ledger(x, RULES).withColumn("pass_no", F.lit(1))
    second = validate.error_ledger(fixed_expenses(x), RULES)
    both = first.unionByName(second.withColumn("pass_no", F.lit(2)))
    return package.error_reasons(both, sample_skips(x))


@query(
    "package_counts",
    twins.with_x(skips=SKIPS)
    + """SELECT (SELECT count(*) FROM x) - (SELECT count(*) FROM skips) AS valid_count,
  (SELECT count(*) FROM skips) AS error_count""",
)
def package_counts(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    return package.package_counts(x, sample_skips(x))


def _run_through(spark, sf_dir: str) -> str:
    """Land the expenses, send the sample fixes, let the second review time out."""
    path = scratch_path(spark, "run")
    landed = settle(expenses(spark, sf_dir), "landed")
    no_map = F.lit(None).cast("map<string,string>").alias("fixes")
    replies = sample_fixes(landed).select(
        "seq", F.lit("fix").alias("kind"), "row_index", "field", "new_value", no_map
    )
    run_review(landed, CONFIG, lambda n, queue: replies if n == 1 else None, path, "1")
    return path


OPEN_AGAIN = {
    **FIXED,
    "again": twins.ledger("y"),
    "e": ENRICHED.replace("FROM x", "FROM y"),
}


@query(
    "run_to_success",
    twins.with_x(**OPEN_AGAIN)
    + "SELECT * FROM e WHERE row_index NOT IN (SELECT row_index FROM again)",
)
def run_to_success(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_run_through(spark, sf_dir)}/success/run_id=1")


@query(
    "run_to_errors",
    twins.with_x(**OPEN_AGAIN)
    + """SELECT e.*, r.error_reason FROM e JOIN (
  SELECT row_index, string_agg(error_message, '; ' ORDER BY rule_no) AS error_reason
  FROM again GROUP BY row_index) r ON e.row_index = r.row_index""",
)
def run_to_errors(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_run_through(spark, sf_dir)}/errors/run_id=1")


# --- run log ----------------------------------------------------------------

# The event table read as a run log: a user is a run, an event type a status.
LOG_SQL = """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type
  WHEN 'signup' THEN 'IDLE' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'WAITING_FOR_USER'
  WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  'file-' || CAST(user_id AS STRING) || '.csv' AS file_name, props FROM {events}"""
LOG = LOG_SQL.format(events="events")


def run_log(spark, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    return spark.sql(LOG_SQL, events=events)


LATEST = f"""SELECT run_id, max(seq) AS seq, arg_max(status, seq) AS status,
  arg_max(file_name, seq) AS file_name, epoch_us(min(ts)) AS created_us FROM ({LOG})
GROUP BY run_id"""


@query("run_list", LATEST)
def run_list(spark, sf_dir: str) -> DataFrame:
    listed = runs.list_runs(run_log(spark, sf_dir))
    created = F.unix_micros(F.col("created").cast("timestamp"))
    return listed.select("run_id", "seq", "status", "file_name", created.alias("created_us"))


@query(
    "run_latest",
    f"SELECT run_id, max(seq) AS seq, arg_max(status, seq) AS status,"
    f" arg_max(props, seq) AS props FROM ({LOG}) GROUP BY run_id",
)
def run_latest(spark, sf_dir: str) -> DataFrame:
    latest = runs.latest_per_run(run_log(spark, sf_dir))
    return latest.select("run_id", "seq", "status", "props")


@query(
    "run_detail",
    f"SELECT run_id, seq, status, props FROM ({LOG}) WHERE run_id = 7 ORDER BY seq DESC LIMIT 1",
)
def run_detail(spark, sf_dir: str) -> DataFrame:
    detail = runs.run_detail(run_log(spark, sf_dir), 7)
    return detail.select("run_id", "seq", "status", "props")


TRANSITIONS = f"""SELECT run_id, seq, status, prev_status,
  epoch_us(ts) - epoch_us(prev_ts) AS micros_in_prev,
  CASE WHEN status IN ('INGESTING', 'RUNNING') THEN true
       WHEN prev_status IS NULL OR prev_status IN ('COMPLETED', 'FAILED') THEN status = 'IDLE'
       WHEN status = 'FAILED' THEN true
       WHEN status = 'WAITING_FOR_USER'
         THEN prev_status IN ('RUNNING', 'VALIDATING', 'WAITING_FOR_USER')
       WHEN status = 'VALIDATING' THEN prev_status IN ('RUNNING', 'VALIDATING', 'WAITING_FOR_USER')
       WHEN status = 'TRANSFORMING' THEN prev_status IN ('RUNNING', 'VALIDATING', 'TRANSFORMING')
       WHEN status = 'PACKAGING' THEN prev_status IN ('RUNNING', 'VALIDATING', 'TRANSFORMING')
       WHEN status = 'COMPLETED' THEN prev_status = 'PACKAGING'
       ELSE false END AS is_legal
FROM (SELECT *, lag(status) OVER w AS prev_status, lag(ts) OVER w AS prev_ts FROM ({LOG})
      WINDOW w AS (PARTITION BY run_id ORDER BY seq))"""


@query("run_transitions", TRANSITIONS)
def run_transitions(spark, sf_dir: str) -> DataFrame:
    return runs.with_transitions(run_log(spark, sf_dir)).drop("ts", "file_name", "props")


@query("run_transitions_hot", TRANSITIONS)
def run_transitions_hot(spark, sf_dir: str) -> DataFrame:
    """The same in pieces of 20 rows, so every run above that is cut."""
    seen = runs.with_transitions(run_log(spark, sf_dir), piece_rows=20)
    return seen.drop("ts", "file_name", "props")


STALE_GUARD = f"""SELECT run_id, seq, status FROM (
  SELECT *, last_value(CASE WHEN status <> 'IDLE' THEN status END IGNORE NULLS) OVER (
    PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM ({LOG}))
WHERE NOT (status = 'IDLE' AND last IS NOT NULL AND last NOT IN ('COMPLETED', 'FAILED'))"""


@query("run_stale_guard", STALE_GUARD)
def run_stale_guard(spark, sf_dir: str) -> DataFrame:
    kept = runs.without_stale_idle(run_log(spark, sf_dir))
    return kept.select("run_id", "seq", "status")


@query("run_stale_guard_hot", STALE_GUARD)
def run_stale_guard_hot(spark, sf_dir: str) -> DataFrame:
    kept = runs.without_stale_idle(run_log(spark, sf_dir), piece_rows=20)
    return kept.select("run_id", "seq", "status")


@query(
    "run_summary",
    twins.with_x(**LEDGER, batch=BATCH)
    + """SELECT 'WAITING_FOR_USER' AS status, 'orders.csv' AS file_name,
  (SELECT count(*) FROM x) AS row_count,
  'employee_id,dept,amount,currency,spend_date,vendor,fx_rate' AS columns,
  CAST(0 AS BIGINT) AS columns_left_out,
  (SELECT count(*) FROM ledger) AS all_errors,
  (SELECT count(*) FROM batch) AS pending_review,
  (SELECT string_agg(row_index || ':' || field, ',' ORDER BY row_index, rule_no)
   FROM (SELECT * FROM batch ORDER BY row_index, rule_no LIMIT 5)) AS first_errors,
  'as_of=2001-06-30;usd_rounding=cents;cost_center_map=ENG=300,FIN=100,HR=200,OPS=400' AS settings,
  'success=out/success;errors=out/errors' AS artifacts""",
)
def run_summary(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    queue = validate.review_batch(ledger)
    line = runs.run_summary(
        x, ledger, queue, "WAITING_FOR_USER", "orders.csv", CONFIG,
        {"success": "out/success", "errors": "out/errors"},
    )
    shown = F.transform(
        "first_errors", lambda e: F.concat_ws(":", e["row_index"].cast("string"), e["field"])
    )
    flat = lambda m: F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"
    )
    return line.withColumns(
        {
            "columns": F.array_join("columns", ","),
            "first_errors": F.array_join(shown, ","),
            "settings": flat("settings"),
            "artifacts": flat("artifacts"),
        }
    )


@query(
    "package_guard",
    twins.with_x(**LEDGER, **FIXED, batch=BATCH, skips=SKIPS)
    + f"""SELECT 'queued' AS reason, count(*) AS n FROM batch HAVING count(*) > 0
UNION ALL SELECT 'open', count(*) FROM ({ACTIVE}) HAVING count(*) > 0""",
)
def package_guard(spark, sf_dir: str) -> DataFrame:
    """What keeps the run from being packaged after the sample fixes and skips."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    return package.blocking(
        validate.review_batch(ledger), fixed_expenses(x), ledger, sample_skips(x), fields=RULE_FIELDS
    )


@query(
    "fresh_run_reset",
    twins.with_x(skips=SKIPS) + "SELECT 'a' AS run_id, row_index FROM skips",
)
def fresh_run_reset(spark, sf_dir: str) -> DataFrame:
    """Run b is ingested anew: its skips go, those of run a stay."""
    skips = sample_skips(expenses(spark, sf_dir)).withColumn(
        "run_id", F.explode(F.array(F.lit("a"), F.lit("b")))
    )
    anew = spark.createDataFrame([("b",)], "run_id string")
    return runs.without_runs(skips, anew).select("run_id", "row_index")


@query(
    "confirm_runs",
    """SELECT coalesce(o_orderstatus, run_id) AS run_id, count(o_orderkey) AS row_count,
  CASE WHEN count(o_orderkey) > 0 THEN 'RUNNING' ELSE 'FAILED' END AS status
FROM (VALUES ('F'), ('O'), ('P'), ('empty')) AS runs(run_id)
LEFT JOIN orders ON o_orderstatus = run_id GROUP BY 1""",
)
def confirm_runs(spark, sf_dir: str) -> DataFrame:
    """An ingest with rows goes on, one without has failed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"))
    asked = spark.createDataFrame([("F",), ("O",), ("P",), ("empty",)], "run_id string")
    return runs.confirm_runs(orders, asked)
