import datetime as dt

import pytest

from rowsieve.config import RunConfig, resolve_as_of
from rowsieve.operators import validate
from rowsieve.operators.rules import PatternRule, RuleSet, expense_rules
from tests.helpers import RULES, collect, model_errors, random_rows, row, table

CASES = [
    ({}, []),
    ({"employee_id": "A1B2"}, []),
    ({"employee_id": "ABCDEF123456"}, []),
    ({"employee_id": "ABC"}, [(1, "Invalid employee_id format: 'ABC'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"employee_id": "ABCDEF1234567"}, [(1, "Invalid employee_id format: 'ABCDEF1234567'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"employee_id": "EMP-01"}, [(1, "Invalid employee_id format: 'EMP-01'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"employee_id": "emp001"}, [(1, "Invalid employee_id format: 'emp001'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"employee_id": "EMP001\n"}, [(1, "Invalid employee_id format: 'EMP001\n'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"employee_id": None}, [(1, "Invalid employee_id format: 'None'. Must be 4-12 alphanumeric characters (A-Z, 0-9).")]),
    ({"dept": "FIN"}, []),
    ({"dept": "Engineering"}, [(2, "Invalid department 'Engineering'. Must be one of: ['ENG', 'FIN', 'HR', 'OPS'].")]),
    ({"dept": "eng"}, [(2, "Invalid department 'eng'. Must be one of: ['ENG', 'FIN', 'HR', 'OPS'].")]),
    ({"dept": None}, [(2, "Invalid department 'None'. Must be one of: ['ENG', 'FIN', 'HR', 'OPS'].")]),
    ({"amount": "100000"}, []),
    ({"amount": "0.01"}, []),
    ({"amount": " 12.5 "}, []),
    ({"amount": "1e3"}, []),
    ({"amount": "0"}, [(3, "Amount 0 out of range. Must be > 0 and <= 100,000.")]),
    ({"amount": "-100"}, [(3, "Amount -100 out of range. Must be > 0 and <= 100,000.")]),
    ({"amount": "100000.01"}, [(3, "Amount 100000.01 out of range. Must be > 0 and <= 100,000.")]),
    ({"amount": "abc"}, [(3, "Invalid amount value: 'abc'.")]),
    ({"amount": "1d"}, [(3, "Invalid amount value: '1d'.")]),
    ({"amount": "nan"}, [(3, "Invalid amount value: 'nan'.")]),
    ({"amount": "1_000"}, [(3, "Invalid amount value: '1_000'.")]),
    ({"amount": None}, [(3, "Invalid amount value: 'None'.")]),
    ({"currency": "JPY"}, [(4, "Invalid currency 'JPY'. Must be one of: ['EUR', 'GBP', 'INR', 'USD'].")]),
    # An invalid currency leaves fx_rate unchecked.
    ({"currency": "CHF", "fx_rate": None}, [(4, "Invalid currency 'CHF'. Must be one of: ['EUR', 'GBP', 'INR', 'USD'].")]),
    ({"spend_date": "2024-06-30"}, []),
    ({"spend_date": "2024-1-5"}, []),
    ({"spend_date": "2024-07-01"}, [(5, "Future date '2024-07-01' not allowed.")]),
    ({"spend_date": "01/15/2024"}, [(5, "Invalid date format '01/15/2024'. Must be YYYY-MM-DD.")]),
    ({"spend_date": "2024-02-30"}, [(5, "Invalid date format '2024-02-30'. Must be YYYY-MM-DD.")]),
    ({"spend_date": " 2024-01-15"}, [(5, "Invalid date format ' 2024-01-15'. Must be YYYY-MM-DD.")]),
    ({"spend_date": "2024-01-15T00:00"}, [(5, "Invalid date format '2024-01-15T00:00'. Must be YYYY-MM-DD.")]),
    ({"spend_date": "0000-01-15"}, [(5, "Invalid date format '0000-01-15'. Must be YYYY-MM-DD.")]),
    ({"spend_date": None}, [(5, "Invalid date format 'None'. Must be YYYY-MM-DD.")]),
    ({"vendor": ""}, [(6, "Vendor must not be empty.")]),
    ({"vendor": " \t "}, [(6, "Vendor must not be empty.")]),
    ({"vendor": None}, [(6, "Vendor must not be empty.")]),
    ({"currency": "EUR", "fx_rate": "0.1"}, []),
    ({"currency": "EUR", "fx_rate": "500"}, []),
    ({"currency": "USD", "fx_rate": None}, []),
    ({"currency": "EUR", "fx_rate": None}, [(7, "fx_rate is required for non-USD currency 'EUR'.")]),
    ({"currency": "GBP", "fx_rate": "0.01"}, [(7, "fx_rate 0.01 out of range [0.1, 500].")]),
    ({"currency": "INR", "fx_rate": "501"}, [(7, "fx_rate 501 out of range [0.1, 500].")]),
    ({"currency": "EUR", "fx_rate": "abc"}, [(7, "Invalid fx_rate value: 'abc'.")]),
    # A large amount of the finance department is no error.
    ({"dept": "FIN", "amount": "60000"}, []),
]


def test_every_rule_case(spark):
    rows = [row(**{"employee_id": "EMP001", **changes}) for changes, _ in CASES]
    found = validate.row_errors(table(spark, rows), RULES)
    got = {}
    for r in found.orderBy("row_index", "rule_no").collect():
        got.setdefault(r["row_index"], []).append((r["rule_no"], r["error_message"]))
    for i, (changes, expected) in enumerate(CASES):
        assert got.get(i, []) == expected, changes


def test_rules_do_not_stop_at_the_first_error(spark):
    bad = row(employee_id="x", dept="x", amount="x", currency="x", spend_date="x", vendor="")
    found = validate.row_errors(table(spark, [bad]), RULES).orderBy("rule_no").collect()
    assert [r["rule_no"] for r in found] == [1, 2, 3, 4, 5, 6]
    assert [r["current_value"] for r in found] == ["x", "x", "x", "x", "x", ""]


def test_null_vendor_may_pass(spark):
    lenient = expense_rules(RunConfig(as_of="2024-06-30"), null_text_passes=True)
    found = validate.row_errors(table(spark, [row(vendor=None), row(vendor=" ")]), lenient)
    assert collect(found, "row_index", "rule_no") == [(1, 6)]


def test_absent_columns_read_as_empty(spark):
    df = spark.createDataFrame([(0, "EMP001")], "row_index bigint, employee_id string")
    found = validate.row_errors(df, RULES).orderBy("rule_no").collect()
    assert [(r["rule_no"], r["current_value"]) for r in found] == [
        (2, ""), (3, ""), (4, ""), (5, ""), (6, ""),
    ]
    assert found[1]["error_message"].startswith("Amount 0 out of range")


def test_duplicate_names_the_previous_row(spark):
    rows = [row(), row(), row(employee_id="EMP002"), row()]
    found = validate.duplicate_errors(table(spark, rows), RULES.unique)
    messages = {r["row_index"]: r["error_message"] for r in found.collect()}
    assert messages == {
        1: "Duplicate (employee_id, spend_date) pair 'QX7741', '2024-04-09' — also at row 0.",
        3: "Duplicate (employee_id, spend_date) pair 'QX7741', '2024-04-09' — also at row 1.",
    }


def test_null_pairs_match_each_other(spark):
    rows = [row(employee_id=None, spend_date=None)] * 3
    found = validate.repeated_rows(table(spark, rows), RULES.unique.columns)
    assert collect(found, "row_index", "prev_row") == [(1, 0), (2, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_brute_force(spark, seed):
    rows = random_rows(400, seed)
    skipped = {i for i in range(0, 400, 7)}
    marks = spark.createDataFrame([(i,) for i in skipped], "row_index bigint")
    df = table(spark, rows).repartition(5)
    # Pieces of 20 rows: every key of this small alphabet is hot.
    ledger = validate.error_ledger(df, RULES, skipped=marks, piece_rows=20)
    assert collect(ledger, "row_index", "rule_no") == model_errors(rows, skipped)


def test_as_of_falls_back_to_today():
    assert resolve_as_of("2024-01-31") == dt.date(2024, 1, 31)
    assert resolve_as_of("31/01/2024") == dt.date.today()
    assert resolve_as_of(None) == dt.date.today()


def test_digest_depends_on_the_cutoff():
    early, late = (expense_rules(RunConfig(as_of=d)).digest() for d in ("2024-01-01", "2024-01-02"))
    assert early != late
    assert early == expense_rules(RunConfig(as_of="2024-01-01")).digest()


def test_own_rule_set(spark):
    rules = RuleSet((PatternRule(1, "code", r"^[0-9]+\z", "bad code {value}"),))
    df = spark.createDataFrame([(0, "12"), (1, "x{y}")], "row_index bigint, code string")
    assert collect(validate.error_ledger(df, rules), "row_index", "error_message") == [
        (1, "bad code x{y}")
    ]
