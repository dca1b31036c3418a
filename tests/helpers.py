"""Small tables and a plain-Python model of the rules to compare with."""

from __future__ import annotations

import datetime as dt
import random
import re

from rowsieve.config import EXPENSE_COLUMNS, RunConfig
from rowsieve.operators.rules import expense_rules

AS_OF = "2024-06-30"
CONFIG = RunConfig(as_of=AS_OF)
RULES = expense_rules(CONFIG)

VALID = {
    "employee_id": "QX7741",
    "dept": "ENG",
    "amount": "842.35",
    "currency": "USD",
    "spend_date": "2024-04-09",
    "vendor": "Lark & Sons",
    "fx_rate": "1.0",
}
SCHEMA = "row_index bigint, " + ", ".join(f"{c} string" for c in EXPENSE_COLUMNS)


def row(**changes):
    return {**VALID, **changes}


def table(spark, rows):
    data = [(i, *[r[c] for c in EXPENSE_COLUMNS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def distinct_rows(n, **changes):
    return [row(employee_id=f"EMP{i:04d}", **changes) for i in range(n)]


def collect(df, *columns):
    names = columns or df.columns
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


NUMBER = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", re.ASCII)


def _number(text):
    return float(text) if text is not None and NUMBER.fullmatch(text) else None


def _day(text):
    if text is None or not re.fullmatch(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", text):
        return None
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        return None


def model_errors(rows, skipped=(), as_of=AS_OF):
    """(row_index, rule_no) of every error, by brute force."""
    limit = dt.date.fromisoformat(as_of)
    found, seen = [], set()
    for i, r in enumerate(rows):
        key = (str(r["employee_id"]), str(r["spend_date"]))
        repeated = key in seen
        seen.add(key)
        if i in skipped:
            continue
        amount, rate, day = _number(r["amount"]), _number(r["fx_rate"]), _day(r["spend_date"])
        broken = {
            1: not re.fullmatch("[A-Z0-9]{4,12}", r["employee_id"] or ""),
            2: r["dept"] not in ("FIN", "HR", "ENG", "OPS"),
            3: amount is None or not 0 < amount <= 100000,
            4: r["currency"] not in ("USD", "EUR", "GBP", "INR"),
            5: day is None or day > limit,
            6: not (r["vendor"] or "").strip(),
            7: r["currency"] in ("EUR", "GBP", "INR")
            and (rate is None or not 0.1 <= rate <= 500),
            8: repeated,
        }
        found += [(i, no) for no, is_broken in broken.items() if is_broken]
    return sorted(found, key=repr)


CHOICES = {
    "employee_id": ["EMP001", "EMP002", "EMP003", "emp1", "ABC", None],
    "dept": ["FIN", "HR", "ENG", "OPS", "fin", "SALES", None],
    "amount": ["1", "0", "-5", "100000", "100000.01", "1e3", "abc", " 7 ", "nan", "1d", None],
    "currency": ["USD", "EUR", "GBP", "INR", "JPY", None],
    "spend_date": ["2024-01-15", "2024-1-5", "2024-06-30", "2024-07-01", "2024-02-30",
                   "01/15/2024", None],
    "vendor": ["Acme", "", "   ", "\t", " ", None],
    "fx_rate": ["1.0", "0.1", "0.09", "500", "500.1", "abc", "", None],
}


def random_rows(n, seed):
    pick = random.Random(seed)
    return [{c: pick.choice(CHOICES[c]) for c in EXPENSE_COLUMNS} for _ in range(n)]
