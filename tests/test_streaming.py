from pyspark.sql import functions as F

from rowsieve.operators import validate as batch
from rowsieve.streaming import duplicates, reviews, validate
from rowsieve.streaming.files import folder_stream
from tests.helpers import RULES, collect, random_rows, row, table


def deliver(df, path, *conditions):
    for condition in conditions:
        df.filter(condition).coalesce(1).write.mode("append").parquet(path)


def test_ledger_of_several_deliveries_equals_the_batch_ledger(spark, tmp_path):
    df = table(spark, random_rows(90, 11))
    arrivals, out = str(tmp_path / "in"), str(tmp_path / "out")
    found = None
    for part in range(3):
        deliver(df, arrivals, f"row_index DIV 30 = {part}")
        stream = folder_stream(spark, arrivals, df.schema, max_files=1)
        found = validate.validate_arrivals(stream, RULES, out, str(tmp_path / "check"))
    assert collect(found) == collect(batch.row_errors(df, RULES))


def test_repeats_across_batches_equal_the_batch_result(spark, tmp_path):
    df = table(spark, random_rows(120, 12))
    arrivals, work = str(tmp_path / "in"), str(tmp_path / "work")
    columns = ["employee_id", "spend_date"]
    found = None
    for part in range(4):
        deliver(df, arrivals, f"row_index DIV 30 = {part}")
        stream = folder_stream(spark, arrivals, df.schema, max_files=1)
        found = duplicates.repeats_across_batches(
            stream, columns, work, ttl_ms=3_600_000, piece_rows=10, compact_every=2
        )
    expected = batch.repeated_rows(df, columns).select("row_index", "prev_row")
    assert collect(found) == collect(expected)


def three_deliveries(spark, tmp_path, **options):
    """Rows 0 and 2 share a key; row 1 comes between them."""
    rows = [row(), row(employee_id="EMP002"), row()]
    df = table(spark, rows)
    found = None
    for part in range(3):
        deliver(df, str(tmp_path / "in"), f"row_index = {part}")
        stream = folder_stream(spark, str(tmp_path / "in"), df.schema)
        found = duplicates.repeats_across_batches(
            stream, ["employee_id", "spend_date"], str(tmp_path / "work"), **options
        )
    return collect(found)


def test_state_survives_restarts(spark, tmp_path):
    assert three_deliveries(spark, tmp_path) == [(2, 0)]


def test_state_forgets_after_its_time_to_live(spark, tmp_path):
    assert three_deliveries(spark, tmp_path, ttl_ms=1) == []


def test_repeats_call_no_python_and_forget_when_compacted(spark, tmp_path):
    df = table(spark, random_rows(30, 14))
    work = str(tmp_path / "work")
    deliver(df, str(tmp_path / "in"), *[f"row_index DIV 10 = {i}" for i in range(3)])
    stream = folder_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    duplicates.repeats_across_batches(stream, ["employee_id"], work, ttl_ms=1, compact_every=2)
    base = spark.read.parquet(f"{work}/last/part=base")
    newest = spark.read.parquet(f"{work}/last/part=log/version=2")
    assert base.count() <= newest.count()


def test_revalidation_against_a_cache(spark, tmp_path):
    rows = random_rows(60, 13)
    df = table(spark, rows)
    cache = validate.row_rule_cache(df, RULES)
    after = df.withColumn("dept", F.when(F.col("row_index") < 10, "HR").otherwise(F.col("dept")))
    deliver(after, str(tmp_path / "in"), "row_index < 30", "row_index >= 30")
    stream = folder_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    states = validate.revalidate_arrivals(
        stream, RULES, cache, str(tmp_path / "out"), str(tmp_path / "check")
    )
    clean = {r["row_index"] for r in df.select("row_index").collect()} - {
        r["row_index"] for r in batch.row_errors(df, RULES).collect()
    }
    got = {r["row_index"]: r["state"] for r in states.collect()}
    same = {i for i in range(60) if i >= 10 or rows[i]["dept"] == "HR"}
    assert {i for i, s in got.items() if s == "unchanged"} >= clean & same
    invalid = {r["row_index"] for r in batch.row_errors(after, RULES).collect()}
    assert {r["row_index"] for r in states.filter("NOT is_valid").collect()} == invalid


def test_timed_out_sessions_wait_for_the_watermark(spark, tmp_path):
    rows = [("a", "10:00:00"), ("a", "10:03:00"), ("b", "10:01:00"), ("a", "10:50:00")]
    log = spark.createDataFrame(
        [(r, f"2024-01-01 {t}") for r, t in rows], "run_id string, ts string"
    ).withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = folder_stream(spark, str(tmp_path / "in"), log.schema)
    sessions = reviews.timed_out_sessions(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    # The session that starts at 10:50 may still go on.
    shown = [(r["run_id"], f"{r['timed_out']:%H:%M}", r["n_actions"]) for r in sessions.collect()]
    assert sorted(shown) == [("a", "10:08", 2), ("b", "10:06", 1)]
    open_rows = spark.createDataFrame([("a", 5), ("z", 6)], "run_id string, row_index bigint")
    assert collect(reviews.open_rows_to_skip(sessions, open_rows)) == [("a", 5)]


def test_current_status_over_several_batches(spark, tmp_path):
    log = spark.createDataFrame(
        [("a", 1, "IDLE"), ("b", 2, "RUNNING"), ("a", 3, "RUNNING"), ("a", 4, "FAILED")],
        "run_id string, seq bigint, status string",
    )
    deliver(log, str(tmp_path / "in"), "seq <= 2", "seq = 3", "seq = 4")
    stream = folder_stream(spark, str(tmp_path / "in"), log.schema, max_files=1)
    latest = reviews.current_status(stream, str(tmp_path / "out"), str(tmp_path / "check"), compact_every=1)
    assert (tmp_path / "out" / "part=base").exists()
    assert collect(latest, "run_id", "seq", "status") == [("a", 4, "FAILED"), ("b", 2, "RUNNING")]
