"""Streams run over what has arrived; each equals a batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import EXPENSE_COLUMNS
from rowsieve.plans import twins
from rowsieve.plans.correction_queries import (
    LATEST,
    SESSIONS,
    run_log,
    session_rows,
)
from rowsieve.plans.ledger_queries import LEDGER
from rowsieve.plans.registry import query
from rowsieve.plans.rule_queries import RULES
from rowsieve.session import scratch_path, settle
from rowsieve.sources.tables import expenses, table
from rowsieve.streaming import duplicates, reviews, validate
from rowsieve.streaming.files import folder_stream, table_stream


def expense_stream(spark, sf_dir: str) -> DataFrame:
    """Arriving orders, completed with the static customer tables."""
    return expenses(spark, sf_dir, orders=table_stream(spark, sf_dir, "orders"))


@query(
    "stream_ledger",
    twins.with_x(**LEDGER) + "SELECT * FROM ledger WHERE rule_no < 8",
)
def stream_ledger(spark, sf_dir: str) -> DataFrame:
    work = scratch_path(spark, "stream-ledger")
    return validate.validate_arrivals(
        expense_stream(spark, sf_dir), RULES, f"{work}/ledger", f"{work}/checkpoint"
    )


@query(
    "stream_duplicates",
    """SELECT row_index, prev_row FROM (
  SELECT o_orderkey AS row_index, lag(o_orderkey) OVER (
    PARTITION BY o_custkey, CAST(o_orderdate AS DATE)
    ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey)
    AS prev_row FROM orders) WHERE prev_row IS NOT NULL""",
)
def stream_duplicates(spark, sf_dir: str) -> DataFrame:
    """Orders arrive in three deliveries; the stream runs after each and keeps its state."""
    work = scratch_path(spark, "stream-duplicates")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_index"),
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        "o_orderstatus",
    )
    found = None
    for status in ("F", "O", "P"):
        delivery = orders.filter(F.col("o_orderstatus") == status)
        delivery.write.mode("append").parquet(f"{work}/arrivals")
        arrivals = folder_stream(spark, f"{work}/arrivals", orders.schema)
        found = duplicates.repeats_across_batches(
            arrivals, ["o_custkey", "o_orderdate"], f"{work}/state"
        )
    return found


@query(
    "stream_sessions",
    f"""SELECT * FROM ({SESSIONS})
WHERE timed_out_us <= (SELECT epoch_us(max(ts)) FROM events) - 600000000""",
)
def stream_sessions(spark, sf_dir: str) -> DataFrame:
    """Sessions are final once the watermark (ten minutes behind) has passed their end."""
    work = scratch_path(spark, "stream-sessions")
    actions = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    sessions = reviews.timed_out_sessions(actions, f"{work}/sessions", f"{work}/checkpoint")
    return session_rows(sessions)


@query("stream_latest", LATEST.replace(", epoch_us(min(ts)) AS created_us", ""))
def stream_latest(spark, sf_dir: str) -> DataFrame:
    work = scratch_path(spark, "stream-latest")
    log = run_log(spark, sf_dir, events=table_stream(spark, sf_dir, "events"))
    light = log.select("run_id", "seq", "ts", "status", "file_name")
    latest = reviews.current_status(light, f"{work}/changes", f"{work}/checkpoint")
    return latest.select("run_id", "seq", "status", "file_name")


_FP = twins.fingerprint(EXPENSE_COLUMNS)


@query(
    "stream_incremental",
    twins.with_x(
        **LEDGER,
        y="SELECT * REPLACE (CASE WHEN dept = 'SALES' THEN 'HR' ELSE dept END AS dept) FROM x",
        again=twins.ledger("y"),
        cached=f"""SELECT {_FP} AS fp FROM x
WHERE row_index NOT IN (SELECT row_index FROM ledger WHERE rule_no < 8)""",
    )
    + f"""SELECT row_index, CASE WHEN {_FP} IN (SELECT fp FROM cached) THEN 'unchanged'
  ELSE 'checked' END AS state,
  row_index NOT IN (SELECT row_index FROM again WHERE rule_no < 8) AS is_valid FROM y""",
)
def stream_incremental(spark, sf_dir: str) -> DataFrame:
    """Rows come back with SALES corrected to HR; the others hit the cache of the batch pass."""
    work = scratch_path(spark, "stream-incremental")
    cache = settle(validate.row_rule_cache(expenses(spark, sf_dir), RULES), "cache")
    dept = F.when(F.col("dept") == "SALES", "HR").otherwise(F.col("dept"))
    corrected = expense_stream(spark, sf_dir).withColumn("dept", dept)
    states = validate.revalidate_arrivals(
        corrected, RULES, cache, f"{work}/states", f"{work}/checkpoint"
    )
    return states.select("row_index", "state", "is_valid")


@query(
    "stream_incremental_feedback",
    twins.with_x(
        **LEDGER,
        y="SELECT * REPLACE (CASE WHEN dept = 'SALES' THEN 'HR' ELSE dept END AS dept) FROM x",
        again=twins.ledger("y"),
        early="SELECT * FROM x WHERE dept <> 'FIN'",
        cached=f"""SELECT {_FP} AS fp FROM early
WHERE row_index NOT IN (SELECT row_index FROM ledger WHERE rule_no < 8)""",
    )
    + f"""SELECT 1 AS delivery, row_index, 'checked' AS state,
  row_index NOT IN (SELECT row_index FROM ledger WHERE rule_no < 8) AS is_valid FROM early
UNION ALL
SELECT 2, row_index, CASE WHEN {_FP} IN (SELECT fp FROM cached) THEN 'unchanged' ELSE 'checked' END,
  row_index NOT IN (SELECT row_index FROM again WHERE rule_no < 8) FROM y""",
)
def stream_incremental_feedback(spark, sf_dir: str) -> DataFrame:
    """All but FIN arrives, then everything with SALES corrected; the second delivery skips what the
    first found valid."""
    work = scratch_path(spark, "stream-feedback")
    x = expenses(spark, sf_dir)
    dept = F.when(F.col("dept") == "SALES", "HR").otherwise(F.col("dept"))
    none = settle(validate.row_rule_cache(x.limit(0), RULES), "cache")
    states = None
    for rows in (x.filter("dept <> 'FIN'"), x.withColumn("dept", dept)):
        rows.write.mode("append").parquet(f"{work}/arrivals")
        arrivals = folder_stream(spark, f"{work}/arrivals", x.schema)
        states = validate.revalidate_with_feedback(
            arrivals, RULES, none, f"{work}/log", f"{work}/states", f"{work}/checkpoint"
        )
    return states.select(
        (F.col("batch") + 1).cast("int").alias("delivery"), "row_index", "state", "is_valid"
    )


@query(
    "stream_auto_skips",
    """WITH e AS (
  SELECT user_id AS run_id, ts, event_id, event_type, row_number() OVER w AS rn,
    CASE WHEN ts - lag(ts) OVER w > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS is_new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY run_id ORDER BY rn) AS no FROM e),
t AS (SELECT *, max(ts) OVER (PARTITION BY run_id, no) AS last_ts,
    max(no) OVER (PARTITION BY run_id) AS last_no,
    max(CASE WHEN event_type = 'click' THEN rn END) OVER (PARTITION BY run_id, no) AS cleared
  FROM s)
SELECT run_id, event_id AS row_index, epoch_us(last_ts) + 300000000 AS skipped_us FROM t
WHERE event_type IN ('error', 'view', 'signup') AND rn > coalesce(cleared, 0)
  AND (no < last_no OR last_ts + INTERVAL 300 SECOND
       < (SELECT max(ts) FROM events) - INTERVAL 600 SECOND)""",
)
def stream_auto_skips(spark, sf_dir: str) -> DataFrame:
    """Errors, views and signups open a row, a click answers all open ones, a purchase only restarts
    the clock; what a pause of more than 300 s leaves open is skipped."""
    work = scratch_path(spark, "stream-auto-skips")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "answer").otherwise("open")
    events = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(F.col("event_type") != "click", F.col("event_id")).alias("row_index"),
    )
    skips = reviews.auto_skips(events, f"{work}/skips", f"{work}/checkpoint")
    return skips.select("run_id", "row_index", F.unix_micros("skipped_at").alias("skipped_us"))
