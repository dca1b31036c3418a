import pytest
from pyspark.sql import functions as F

from rowsieve.config import NEXT_STATUSES, STATUSES
from rowsieve.operators import runs, validate
from tests.helpers import RULES, collect, distinct_rows, table


def log(spark, *entries):
    rows = [(run, seq, f"2024-01-01 10:00:{seq:02d}", status) for run, seq, status in entries]
    return spark.createDataFrame(
        rows, "run_id string, seq bigint, ts string, status string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_vocabulary():
    assert len(STATUSES) == 9 and set(NEXT_STATUSES) == set(STATUSES)
    assert {s for following in NEXT_STATUSES.values() for s in following} <= set(STATUSES)


def test_latest_list_and_detail(spark):
    rows = log(spark, ("a", 1, "INGESTING"), ("a", 3, "RUNNING"), ("b", 2, "FAILED"))
    assert collect(runs.latest_per_run(rows), "run_id", "status") == [("a", "RUNNING"), ("b", "FAILED")]
    listed = runs.list_runs(rows.withColumn("file_name", F.lit("f.csv")).withColumn("heavy", F.lit(1)))
    assert "heavy" not in listed.columns
    assert collect(listed, "run_id", "status", "file_name") == [
        ("a", "RUNNING", "f.csv"), ("b", "FAILED", "f.csv"),
    ]
    assert collect(runs.run_detail(rows, "a"), "status") == [("RUNNING",)]
    assert runs.run_detail(rows, "zzz").isEmpty()


@pytest.mark.parametrize("piece_rows", [1_000_000, 2])
def test_transitions(spark, piece_rows):
    rows = log(spark, ("a", 1, "INGESTING"), ("a", 2, "RUNNING"), ("a", 5, "COMPLETED"),
               ("b", 3, "PACKAGING"), ("b", 4, "COMPLETED"))
    seen = runs.with_transitions(rows, piece_rows)
    assert collect(seen, "run_id", "seq", "prev_status", "micros_in_prev", "is_legal") == [
        ("a", 1, None, None, True),
        ("a", 2, "INGESTING", 1_000_000, True),
        ("a", 5, "RUNNING", 3_000_000, False),
        ("b", 3, None, None, False),
        ("b", 4, "PACKAGING", 1_000_000, True),
    ]


@pytest.mark.parametrize("piece_rows", [1_000_000, 2])
def test_stale_idle_is_ignored_until_the_run_ends(spark, piece_rows):
    rows = log(
        spark, ("a", 1, "IDLE"), ("a", 2, "RUNNING"), ("a", 3, "IDLE"), ("a", 4, "IDLE"),
        ("a", 5, "VALIDATING"), ("a", 6, "IDLE"), ("a", 7, "COMPLETED"), ("a", 8, "IDLE"),
    )
    kept = runs.without_stale_idle(rows, piece_rows)
    assert collect(kept, "seq") == [(1,), (2,), (5,), (7,), (8,)]


def test_run_summary(spark):
    df = table(spark, distinct_rows(8, dept="x"))
    ledger = validate.error_ledger(df, RULES)
    line = runs.run_summary(df, ledger, validate.review_batch(ledger), "WAITING_FOR_USER", "f.csv").first()
    assert (line["row_count"], line["all_errors"], line["pending_review"]) == (8, 8, 5)
    assert [e["row_index"] for e in line["first_errors"]] == [0, 1, 2, 3, 4]
    assert len(line["columns"]) == 7
