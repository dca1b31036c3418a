import pytest
from pyspark.sql import functions as F

from rowsieve.operators import corrections, package, validate
from tests.helpers import CONFIG, RULES, collect, distinct_rows, row, table

FIX = "seq bigint, row_index string, field string, new_value string"


def fixes(spark, *entries):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], FIX)


def rows_of(spark, *indices):
    return spark.createDataFrame([(i,) for i in indices], "row_index bigint")


def applied(spark, df, *entries):
    good = corrections.accepted_fixes(fixes(spark, *entries), df)
    return corrections.apply_fixes(df, good)


def test_fix_sets_a_cell_and_the_last_one_wins(spark):
    df = table(spark, distinct_rows(2))
    out = applied(spark, df, ("0", "dept", "HR"), ("1", "dept", "x"), ("1", "dept", "FIN"))
    assert collect(out, "row_index", "dept") == [(0, "HR"), (1, "FIN")]
    assert out.columns == df.columns


def test_fix_to_null_differs_from_no_fix(spark):
    out = applied(spark, table(spark, distinct_rows(2)), ("0", "vendor", None))
    assert collect(out, "row_index", "vendor") == [(0, None), (1, "Lark & Sons")]


def test_fix_of_an_unknown_field_adds_a_column(spark):
    out = applied(spark, table(spark, distinct_rows(2)), ("1", "note", "seen"))
    assert collect(out, "row_index", "note") == [(0, None), (1, "seen")]


def test_typed_columns_keep_their_type(spark):
    df = spark.createDataFrame([(0, 1.5), (1, 2.5)], "row_index bigint, v double")
    out = applied(spark, df, ("0", "v", "9"), ("1", "v", "abc"))
    assert collect(out) == [(0, 9.0), (1, None)]


def test_bad_row_numbers_are_rejected(spark):
    df = table(spark, distinct_rows(3))
    sent = fixes(spark, *[(i, "dept", "HR") for i in ("0", " 2 ", "3", "-1", "x", "1.5", None)])
    assert collect(corrections.accepted_fixes(sent, df), "row_index") == [(0,), (2,)]
    rejected = corrections.rejected_fixes(sent, df).orderBy("seq").collect()
    assert [r["problem"] for r in rejected] == [
        "Row index 3 out of range.",
        "Row index -1 out of range.",
        "Invalid row_index: x. Must be an integer.",
        "Invalid row_index: 1.5. Must be an integer.",
        "Invalid row_index: None. Must be an integer.",
    ]


def test_row_fixes(spark):
    df = table(spark, distinct_rows(3))
    sent = spark.createDataFrame(
        [(0, "1", {"dept": "HR", "amount": "7"}), (1, "2", {}), (2, "0", None), (3, "9", {"a": "b"})],
        "seq bigint, row_index string, fixes map<string,string>",
    )
    cells = corrections.expand_row_fixes(corrections.accepted_fixes(sent, df))
    out = corrections.apply_fixes(df, cells)
    assert collect(out.filter("row_index = 1"), "dept", "amount") == [("HR", "7")]
    problems = corrections.rejected_fixes(sent, df).orderBy("seq").collect()
    empty = "fixes must be a non-empty dict of field->value."
    assert [r["problem"] for r in problems] == [empty, empty, "Row index 9 out of range."]


@pytest.mark.parametrize("piece_rows", [1_000_000, 1])
def test_audit_chains_fixes_of_one_cell(spark, piece_rows):
    df = table(spark, distinct_rows(1))
    sent = fixes(
        spark, ("0", "dept", "HR"), ("0", "dept", None), ("0", "dept", "FIN"), ("0", "note", "n")
    )
    audit = corrections.fix_audit(
        df, corrections.accepted_fixes(sent, df), piece_rows=piece_rows
    ).orderBy("seq")
    assert [(r["field"], r["old_value"], r["new_value"]) for r in audit.collect()] == [
        ("dept", "ENG", "HR"), ("dept", "HR", None), ("dept", None, "FIN"), ("note", None, "n"),
    ]


def test_a_fix_pops_all_errors_of_its_row(spark):
    rows = [row(dept="x", amount="x"), row(employee_id="EMP002", dept="x")]
    batch = validate.review_batch(validate.error_ledger(table(spark, rows), RULES))
    left = corrections.pop_review(batch, rows_of(spark, 0))
    assert collect(left, "row_index") == [(1,)]
    assert corrections.review_action(left).first().asDict() == {
        "remaining_fixes": 1, "action": "WAIT_FOR_MORE_FIXES",
    }
    none = corrections.pop_review(left, rows_of(spark, 1))
    assert corrections.review_action(none).first()["action"] == "REVALIDATE"


def test_only_error_rows_can_be_skipped(spark):
    ledger = validate.error_ledger(table(spark, distinct_rows(1) + [row(dept="x")]), RULES)
    asked = spark.createDataFrame([("0",), ("1",), ("1",), ("x",)], "row_index string")
    taken = corrections.skippable_rows(asked, ledger)
    assert collect(taken, "row_index") == [(1,), (1,)]
    assert collect(corrections.add_skips(rows_of(spark, 1, 5), taken)) == [(1,), (5,)]


def test_skip_all_leaves_repaired_cells_alone(spark):
    rows = distinct_rows(4, dept="x")
    df = table(spark, rows)
    ledger = validate.error_ledger(df, RULES)
    fixed = applied(spark, df, ("0", "dept", "HR"), ("1", "vendor", "other"))
    active = corrections.active_error_rows(fixed, ledger, rows_of(spark, 3))
    assert collect(active) == [(1,), (2,)]


def test_skip_all_counts_null_cells_as_unchanged(spark):
    df = table(spark, [row(vendor=None)])
    active = corrections.active_error_rows(df, validate.error_ledger(df, RULES))
    assert collect(active) == [(0,)]


ANSWER = "seq bigint, kind string, row_index string, field string, new_value string, fixes map<string,string>"


def answer_set(spark, *entries):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], ANSWER)


def answered(spark, *entries, skipped=()):
    df = table(spark, distinct_rows(6, dept="x"))
    ledger = validate.error_ledger(df, RULES)
    return corrections.apply_answers(
        df, ledger, validate.review_batch(ledger), rows_of(spark, *skipped),
        answer_set(spark, *entries),
    )


def test_answers(spark):
    done = answered(
        spark,
        ("skip", "2", None, None, None),
        ("row_fix", "1", None, None, {"dept": "OPS", "vendor": "V"}),
        ("fix", "1", "dept", "HR", None),
        ("fix", "0", "dept", "FIN", None),
        ("fix", "77", "dept", "FIN", None),
        ("skip", "66", None, None, None),
    )
    # The row fix is applied after the cell fixes.
    assert collect(done.table.filter("row_index < 3"), "row_index", "dept", "vendor") == [
        (0, "FIN", "Lark & Sons"), (1, "OPS", "V"), (2, "x", "Lark & Sons"),
    ]
    assert collect(done.skipped) == [(2,)]
    assert collect(done.pending, "row_index") == [(3,), (4,)]
    assert done.counts.first().asDict() == {
        "applied_count": 4, "skipped_count": 1, "pending_count": 2,
    }


def test_skip_all_stands_alone(spark):
    done = answered(
        spark, ("skip_all", None, None, None, None), ("fix", "0", "dept", "FIN", None), skipped=[5]
    )
    assert collect(done.table, "dept") == [("x",)] * 6
    assert collect(done.skipped) == [(i,) for i in range(6)]
    assert done.counts.first().asDict() == {
        "applied_count": 0, "skipped_count": 5, "pending_count": 0,
    }


def test_no_answers_change_nothing(spark):
    done = answered(spark)
    assert done.counts.first().asDict() == {
        "applied_count": 0, "skipped_count": 0, "pending_count": 5,
    }


def test_idle_runs_and_sessions(spark):
    log = spark.createDataFrame(
        [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:04:59"), ("a", "2024-01-01 10:20:00"),
         ("b", "2024-01-01 10:29:00")], "run_id string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    idle = corrections.idle_runs(log, "2024-01-01 10:30:00")
    assert collect(idle, "run_id") == [("a",)]
    for options in ({}, {"piece_rows": 1}):
        sessions = corrections.review_sessions(log, **options)
        shown = [(r["run_id"], f"{r['timed_out']:%H:%M:%S}", r["n_actions"])
                 for r in sessions.orderBy("run_id", "started").collect()]
        assert shown == [("a", "10:09:59", 2), ("a", "10:25:00", 1), ("b", "10:34:00", 1)]


# --- split ------------------------------------------------------------------


def test_split_is_a_partition_of_the_input(spark):
    rows = distinct_rows(3) + [row(employee_id="x", dept="x"), row(employee_id="EMP9", amount="0")]
    df = table(spark, rows)
    ledger = validate.error_ledger(df, RULES)
    skipped = rows_of(spark, 3, 4, 99)
    success, errors = package.split_rows(df, skipped, ledger, CONFIG)
    assert collect(success, "row_index") == [(0,), (1,), (2,)]
    assert errors.columns[-1] == "error_reason"
    reasons = dict(collect(errors, "row_index", "error_reason"))
    assert reasons == {
        3: "Invalid employee_id format: 'x'. Must be 4-12 alphanumeric characters (A-Z, 0-9).; "
        "Invalid department 'x'. Must be one of: ['ENG', 'FIN', 'HR', 'OPS'].",
        4: "Amount 0 out of range. Must be > 0 and <= 100,000.",
    }
    assert package.package_counts(df, skipped).first().asDict() == {
        "valid_count": 3, "error_count": 2,
    }


def test_reason_comes_from_the_latest_pass_with_errors(spark):
    df = table(spark, distinct_rows(2, dept="x"))
    first = validate.error_ledger(df, RULES).withColumn("pass_no", F.lit(1))
    later = first.filter("row_index = 0").withColumns(
        {"pass_no": F.lit(2), "error_message": F.lit("newer")}
    )
    reasons = package.error_reasons(first.unionByName(later), rows_of(spark, 0, 1))
    got = dict(collect(reasons))
    assert got[0] == "newer" and got[1].startswith("Invalid department")


def test_skipped_row_without_a_known_error_has_an_empty_reason(spark):
    df = table(spark, distinct_rows(1))
    errors = package.error_rows(df, rows_of(spark, 0), validate.error_ledger(df, RULES))
    assert collect(errors, "error_reason") == [("",)]


def test_packaging_waits_for_the_review(spark):
    df = table(spark, distinct_rows(1, dept="x"))
    ledger = validate.error_ledger(df, RULES)
    none = ledger.limit(0)
    with pytest.raises(package.PendingReviewError):
        package.check_ready("WAITING_FOR_USER", none)
    with pytest.raises(package.PendingReviewError):
        package.check_ready("RUNNING", ledger)
    with pytest.raises(package.PendingReviewError):
        package.check_ready("RUNNING", none, df, ledger, rows_of(spark))
    package.check_ready("RUNNING", none, df, ledger, rows_of(spark, 0))
    package.check_ready("VALIDATING", none)


def test_audit_reads_only_columns_that_fixes_name(spark, tmp_path):
    table(spark, [row(), row(employee_id="EMP2")]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    fixes = spark.createDataFrame([(0, 1, "dept", "HR")], "seq bigint, row_index bigint, field string, new_value string")
    audit = corrections.fix_audit(df, fixes)
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_index:bigint,dept:string>" in plan
    assert collect(audit, "field", "old_value", "new_value") == [("dept", row()["dept"], "HR")]
