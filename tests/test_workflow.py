import pytest
from pyspark.sql import functions as F

from rowsieve.operators import package, runs
from rowsieve.operators.package import PendingReviewError
from rowsieve.plans.workflow import run_review
from tests.helpers import CONFIG, collect, distinct_rows, row, table
from tests.test_corrections import ANSWER


def outputs(spark, out):
    success = spark.read.parquet(f"{out}/success/run_id=r")
    errors = spark.read.parquet(f"{out}/errors/run_id=r")
    return success, errors


def test_clean_table_needs_no_review(spark, tmp_path):
    def nobody(pass_no, queue):
        raise AssertionError("no review expected")

    report = run_review(table(spark, distinct_rows(3)), CONFIG, nobody, str(tmp_path), "r")
    assert report.counts == {"valid_count": 3, "error_count": 0}
    assert [entry[3] for entry in report.log] == [
        "INGESTING", "RUNNING", "VALIDATING", "PACKAGING", "COMPLETED",
    ]
    assert report.log_rows(spark).count() == 5


def test_five_rows_at_a_time_until_clean(spark, tmp_path):
    df = table(spark, distinct_rows(12, dept="SALES"))
    sizes = []

    def fix_queue(pass_no, queue):
        sizes.append(queue.count())
        return queue.select(
            F.col("row_index").alias("seq"),
            F.lit("fix").alias("kind"),
            F.col("row_index").cast("string"),
            "field",
            F.lit("HR").alias("new_value"),
            F.lit(None).cast("map<string,string>").alias("fixes"),
        )

    report = run_review(df, CONFIG, fix_queue, str(tmp_path), "r")
    assert sizes == [5, 5, 2] and report.passes == 4
    success, _ = outputs(spark, tmp_path)
    assert collect(success.groupBy("dept", "cost_center").count()) == [("HR", "200", 12)]


def test_fix_one_skip_one_time_out_on_the_rest(spark, tmp_path):
    rows = [row(), row(), row(employee_id="EMP2", amount="0"), row(employee_id="EMP3", vendor=None)]

    def answer(pass_no, queue):
        if pass_no > 1:
            return None
        return spark.createDataFrame(
            [(0, "fix", "1", "employee_id", "EMP009", None), (1, "skip", "2", None, None, None)],
            ANSWER,
        )

    report = run_review(table(spark, rows), CONFIG, answer, str(tmp_path), "r")
    assert report.counts == {"valid_count": 2, "error_count": 2}
    assert runs.with_transitions(report.log_rows(spark)).filter("NOT is_legal").isEmpty()
    success, errors = outputs(spark, tmp_path)
    assert collect(success, "row_index", "employee_id") == [(0, "QX7741"), (1, "EMP009")]
    assert collect(errors, "row_index", "error_reason") == [
        (2, "Amount 0 out of range. Must be > 0 and <= 100,000."),
        (3, "Vendor must not be empty."),
    ]


def test_later_pass_wins_over_an_earlier_fix(spark, tmp_path):
    def answer(pass_no, queue):
        value = {1: "NOPE", 2: "OPS"}[pass_no]
        return spark.createDataFrame([(5 - pass_no, "fix", "0", "dept", value, None)], ANSWER)

    run_review(table(spark, [row(dept="x")]), CONFIG, answer, str(tmp_path), "r")
    success, _ = outputs(spark, tmp_path)
    assert collect(success, "dept") == [("OPS",)]


def test_giving_up_keeps_the_guard(spark, tmp_path):
    def useless(pass_no, queue):
        return spark.createDataFrame([], ANSWER)

    with pytest.raises(PendingReviewError):
        run_review(
            table(spark, [row(dept="x")]), CONFIG, useless, str(tmp_path), "r", max_passes=2
        )


def test_fixes_meet_the_table_once_before_it_is_split(spark, tmp_path, monkeypatch):
    # Each step behind the review joined the whole table to the fixes again.
    seen, split = [], package.split_rows

    def watched(df, *rest):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return split(df, *rest)

    monkeypatch.setattr(package, "split_rows", watched)
    rows = [row(), row(employee_id="EMP2", amount="0"), row(employee_id="EMP3", vendor=None)]
    fix = [(0, "fix", "1", "amount", "7.00", None)]
    replies = lambda n, queue: spark.createDataFrame(fix, ANSWER) if n == 1 else None
    report = run_review(table(spark, rows), CONFIG, replies, str(tmp_path), "r")
    assert len(seen) == 1 and "Join" not in seen[0]
    assert report.counts == {"valid_count": 2, "error_count": 1}
    success, errors = outputs(spark, tmp_path)
    assert collect(success, "row_index", "amount")[1] == (1, "7.00") and collect(errors, "row_index") == [(2,)]
