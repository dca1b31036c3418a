import pytest

from rowsieve.functions.fingerprint import with_fingerprint
from rowsieve.operators import incremental, validate
from rowsieve.operators.rules import RuleSet
from tests.helpers import RULES, collect, distinct_rows, model_errors, random_rows, row, table


def ledger_of_bad_depts(spark, n):
    return validate.error_ledger(table(spark, distinct_rows(n, dept="BAD")), RULES)


@pytest.mark.parametrize("n, batch", [(3, 3), (5, 5), (8, 5), (10, 5)])
def test_batch_holds_the_five_lowest_rows(spark, n, batch):
    ledger = ledger_of_bad_depts(spark, n)
    assert ledger.count() == n
    assert collect(validate.review_batch(ledger), "row_index") == [(i,) for i in range(batch)]


def test_batch_keeps_all_errors_of_its_rows(spark):
    rows = [row(employee_id=f"x{i}", dept="BAD", amount="0", vendor="") for i in range(7)]
    batch = validate.review_batch(validate.error_ledger(table(spark, rows), RULES))
    assert batch.count() == 20
    assert collect(batch.select("row_index").distinct()) == [(i,) for i in range(5)]


def test_summary(spark):
    rows = distinct_rows(8, dept="BAD", amount="0") + [row(employee_id="GOOD1")]
    df = table(spark, rows)
    ledger = validate.error_ledger(df, RULES)
    assert validate.validation_summary(df, ledger).first().asDict() == {
        "total_rows": 9,
        "valid_count": 1,
        "error_count": 8,
        "skipped_unchanged": 0,
        "pending_review_count": 10,
        "batch_size": 5,
    }


def test_summary_counts_user_skipped_rows_as_valid(spark):
    df = table(spark, distinct_rows(3, dept="BAD"))
    skipped = spark.createDataFrame([(1,)], "row_index bigint")
    states = incremental.row_states(df, RULES, skipped=skipped)
    summary = validate.validation_summary(
        df, incremental.ledger_of(states), incremental.unchecked_of(states)
    ).first()
    assert (summary["valid_count"], summary["error_count"], summary["skipped_unchanged"]) == (
        1, 2, 1,
    )


def test_completion_metrics(spark):
    df = table(spark, distinct_rows(15))
    skipped = spark.createDataFrame([(1,), (2,)], "row_index bigint")
    ledger = ledger_of_bad_depts(spark, 3)
    done = validate.completion_metrics(df, ledger.limit(0), skipped).first().asDict()
    assert done == {"total_rows": 15, "valid_count": 13, "error_count": 2, "fixed_count": 0}
    waiting = validate.completion_metrics(df, ledger, skipped).first().asDict()
    assert waiting == {"total_rows": 15, "valid_count": 12, "error_count": 3, "fixed_count": 3}


def test_errors_by_row_and_field(spark):
    df = table(spark, [row(dept="x", amount="x"), row(employee_id="EMP002", dept="x")])
    ledger = validate.error_ledger(df, RULES)
    grouped = {r["row_index"]: [e["rule_no"] for e in r["errors"]]
               for r in validate.errors_by_row(ledger).collect()}
    assert grouped == {0: [2, 3], 1: [2]}
    assert collect(validate.error_rows_by_field(ledger)) == [("amount", 1, 1), ("dept", 2, 2)]
    assert validate.error_row_count(ledger).first()[0] == 2
    assert validate.error_row_count(ledger, approximate=True).first()[0] == 2


def test_outcome(spark):
    clean = validate.error_ledger(table(spark, [row()]), RULES)
    assert validate.outcome_status(clean).first()[0] == "VALIDATING"
    assert validate.outcome_status(ledger_of_bad_depts(spark, 1)).first()[0] == "WAITING_FOR_USER"


def test_runs_side_by_side(spark):
    """With run_id in the row key, runs do not see each other's rows."""
    one = table(spark, [row(), row()]).selectExpr("'a' AS run_id", "*")
    two = table(spark, [row(), row(dept="x")]).selectExpr("'b' AS run_id", "*")
    key = ("run_id", "row_index")
    ledger = validate.error_ledger(one.union(two), RULES, row_key=key)
    assert collect(ledger, "run_id", "row_index", "rule_no") == [
        ("a", 1, 8), ("b", 1, 2), ("b", 1, 8),
    ]


# --- fingerprints -----------------------------------------------------------


def prints(df):
    return [r[0] for r in with_fingerprint(df).orderBy("row_index").select("row_fp").collect()]


def test_fingerprint_is_stable_and_order_free(spark):
    df = table(spark, [row(), row(vendor=None), row(vendor="null"), row(vendor="~")])
    got = prints(df)
    assert all(len(fp) == 64 for fp in got) and len(set(got)) == 4
    assert got == prints(df.select(*reversed(df.columns)).repartition(3))


def test_fingerprint_rounds_floats_and_joins_nan_with_null(spark):
    schema = "row_index bigint, v double"
    data = [(0, 0.1 + 0.2), (1, 0.3), (2, 0.300001), (3, float("nan")), (4, None), (5, -0.0), (6, 0.0)]
    a, b, c, nan, null, minus, zero = prints(spark.createDataFrame(data, schema))
    assert a == b != c
    assert nan == null and minus == zero


def test_fingerprint_cells_cannot_run_into_each_other(spark):
    data = [(0, "x", "y=1:z"), (1, "xb=1:y", "z"), (2, None, "x"), (3, "x", None)]
    assert len(set(prints(spark.createDataFrame(data, "row_index bigint, a string, b string")))) == 4


# --- incremental ------------------------------------------------------------


def second_pass(spark, before, after, skipped=None):
    first = incremental.row_states(table(spark, before), RULES)
    return incremental.row_states(
        table(spark, after), RULES, skipped=skipped, cache=incremental.cache_of(first, RULES)
    )


def states(df):
    return [r["state"] for r in df.orderBy("row_index").collect()]


def test_unchanged_valid_rows_are_skipped(spark):
    rows = distinct_rows(3)
    assert states(second_pass(spark, rows, rows)) == ["unchanged"] * 3


def test_invalid_and_changed_rows_are_checked_again(spark):
    before = distinct_rows(2) + [row(employee_id="BAD", dept="x")]
    after = [dict(r) for r in before]
    after[1]["dept"] = "HR"
    after[2]["employee_id"] = "GOOD1"
    again = second_pass(spark, before, after)
    assert states(again) == ["unchanged", "checked", "checked"]
    assert collect(incremental.ledger_of(again), "row_index", "rule_no") == [(2, 2)]


def test_cached_row_that_became_a_duplicate_is_reported(spark):
    before = [row(), row(employee_id="EMP002")]
    after = [row(employee_id="EMP002", vendor="Other"), row(employee_id="EMP002")]
    again = second_pass(spark, before, after)
    assert states(again) == ["checked", "checked"]
    assert collect(incremental.ledger_of(again), "row_index", "rule_no") == [(1, 8)]


def test_user_skipped_rows_still_count_for_duplicates(spark):
    skipped = spark.createDataFrame([(0,)], "row_index bigint")
    again = incremental.row_states(table(spark, [row(), row()]), RULES, skipped=skipped)
    assert states(again) == ["user_skipped", "checked"]
    assert collect(incremental.ledger_of(again), "row_index", "rule_no") == [(1, 8)]
    assert collect(again, "row_index", "is_valid") == [(0, False), (1, False)]


def test_last_of_equal_rows_decides_the_cache(spark):
    """Rows 0 and 1 are equal: row 1 is a repeat, so row 0 is checked again next time."""
    first = incremental.row_states(table(spark, [row(), row()]), RULES)
    cache = incremental.cache_of(first, RULES)
    assert [r["is_valid"] for r in cache.collect()] == [False]
    again = incremental.row_states(table(spark, [row(), row()]), RULES, cache=cache)
    assert states(again) == ["checked", "checked"]


def test_cache_of_other_rules_is_ignored(spark):
    rows = distinct_rows(2)
    first = incremental.row_states(table(spark, rows), RULES)
    cache = incremental.cache_of(first, RuleSet(RULES.row_rules))
    again = incremental.row_states(table(spark, rows), RULES, cache=cache)
    assert states(again) == ["checked", "checked"]


def test_copies_without_a_unique_rule_use_the_salted_lookup(spark):
    rules = RuleSet(RULES.row_rules)
    rows = [row()] * 50 + [row(dept="x")] * 50 + distinct_rows(20)
    first = incremental.row_states(table(spark, rows), rules)
    cache = incremental.cache_of(first, rules)
    again = incremental.row_states(
        table(spark, rows), rules, cache=cache, piece_rows=10, broadcast_rows=0
    )
    expected = ["unchanged"] * 50 + ["checked"] * 50 + ["unchanged"] * 20
    assert states(again) == expected


@pytest.mark.parametrize("seed", [5, 6])
def test_a_cache_asked_first_gives_the_states_of_one_asked_last(spark, seed):
    before, after = random_rows(80, seed), random_rows(80, seed)
    for i, other in enumerate(random_rows(80, seed + 50)):
        if i % 7 == 0:
            after[i] = other
    cache = incremental.cache_of(incremental.row_states(table(spark, before), RULES), RULES)
    skipped = spark.createDataFrame([(3,), (14,)], "row_index bigint")
    first = incremental.row_states(table(spark, after), RULES, skipped, cache)
    last = incremental.row_states(table(spark, after), RULES, skipped, cache, broadcast_rows=0)
    assert collect(first) == collect(last)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    # The cells that the rules read are masked above the join with the cache.
    assert "is_cached" in plan[: plan.index("Join LeftOuter")]


def test_invalidate_cache(spark):
    df = table(spark, distinct_rows(3))
    cache = incremental.cache_of(incremental.row_states(df, RULES), RULES)
    fps = with_fingerprint(df).select("row_index", "row_fp")
    left = incremental.invalidate_cache(
        cache, RULES, fixed=fps.filter("row_index = 0"), skipped=fps.filter("row_index = 1")
    )
    got = {r["row_index"]: r["is_valid"] for r in left.join(fps, "row_fp").collect()}
    assert got == {1: False, 2: True}


def test_changed_rows(spark):
    before = table(spark, distinct_rows(3))
    after = table(spark, distinct_rows(1) + [row(employee_id="NEW01")]).unionByName(
        spark.createDataFrame([(9, *row().values())], before.schema)
    )
    assert collect(incremental.changed_rows(before, after), "row_index", "change") == [
        (0, "same"), (1, "changed"), (2, "removed"), (9, "added"),
    ]


@pytest.mark.parametrize("seed", [3, 4])
def test_incremental_and_refreshed_ledgers_equal_a_full_one(spark, seed):
    before, after = random_rows(120, seed), random_rows(120, seed)
    for i, other in enumerate(random_rows(120, seed + 100)):
        if i % 9 == 0:
            after[i] = other
    skipped = spark.createDataFrame([(i,) for i in range(0, 120, 13)], "row_index bigint")
    expected = model_errors(after, set(range(0, 120, 13)))

    again = second_pass(spark, before, after, skipped)
    assert collect(incremental.ledger_of(again), "row_index", "rule_no") == expected

    old, new = table(spark, before), table(spark, after)
    changed = spark.createDataFrame([(i,) for i in range(0, 120, 9)], "row_index bigint")
    refreshed = incremental.refresh_ledger(
        old, new, changed, validate.error_ledger(old, RULES), RULES, skipped
    )
    full = validate.error_ledger(new, RULES, skipped)
    assert collect(refreshed, "row_index", "rule_no") == expected
    assert collect(refreshed) == collect(full.select(*refreshed.columns))
