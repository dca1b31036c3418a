"""SQL texts shared by the twins of several queries.

These restate the semantics independently of the DataFrame operators.
"""

from __future__ import annotations

from rowsieve.sources.tables import EXPENSE_AS_OF, EXPENSE_VIEW

AS_OF = EXPENSE_AS_OF
X = EXPENSE_VIEW.format(orders="orders", customer="customer", nation="nation")
NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
DAY = r"'^[0-9]{4}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9])$'"


def number(cell: str, kind: str = "DOUBLE") -> str:
    return f"CASE WHEN regexp_matches({cell}, {NUMBER}) THEN try_cast({cell} AS {kind}) END"


def day(cell: str) -> str:
    return (
        f"CASE WHEN regexp_matches({cell}, {DAY}) AND {cell} NOT LIKE '0000-%'"
        f" THEN try_cast({cell} AS DATE) END"
    )


def text(cell: str) -> str:
    return f"coalesce({cell}, 'None')"


def ledger(table: str) -> str:
    """All errors of an expense table, rule by rule."""
    amount, fx, spent = number("amount"), number("fx_rate"), day("spend_date")
    return f"""
SELECT row_index, 1 AS rule_no, 'employee_id' AS field, {text('employee_id')} AS current_value,
  'Invalid employee_id format: ''' || {text('employee_id')}
    || '''. Must be 4-12 alphanumeric characters (A-Z, 0-9).' AS error_message
FROM {table} WHERE NOT coalesce(regexp_matches(employee_id, '^[A-Z0-9]{{4,12}}$'), false)
UNION ALL
SELECT row_index, 2, 'dept', {text('dept')},
  'Invalid department ''' || {text('dept')}
    || '''. Must be one of: [''ENG'', ''FIN'', ''HR'', ''OPS''].'
FROM {table} WHERE dept IS NULL OR dept NOT IN ('FIN', 'HR', 'ENG', 'OPS')
UNION ALL
SELECT row_index, 3, 'amount', {text('amount')},
  CASE WHEN n IS NULL THEN 'Invalid amount value: ''' || {text('amount')} || '''.'
       ELSE 'Amount ' || amount || ' out of range. Must be > 0 and <= 100,000.' END
FROM (SELECT *, {amount} AS n FROM {table}) WHERE n IS NULL OR n <= 0 OR n > 100000
UNION ALL
SELECT row_index, 4, 'currency', {text('currency')},
  'Invalid currency ''' || {text('currency')}
    || '''. Must be one of: [''EUR'', ''GBP'', ''INR'', ''USD''].'
FROM {table} WHERE currency IS NULL OR currency NOT IN ('USD', 'EUR', 'GBP', 'INR')
UNION ALL
SELECT row_index, 5, 'spend_date', {text('spend_date')},
  CASE WHEN d IS NULL
       THEN 'Invalid date format ''' || {text('spend_date')} || '''. Must be YYYY-MM-DD.'
       ELSE 'Future date ''' || spend_date || ''' not allowed.' END
FROM (SELECT *, {spent} AS d FROM {table}) WHERE d IS NULL OR d > DATE '{AS_OF}'
UNION ALL
SELECT row_index, 6, 'vendor', {text('vendor')}, 'Vendor must not be empty.'
FROM {table} WHERE vendor IS NULL OR regexp_matches(vendor, '^\\s*$')
UNION ALL
SELECT row_index, 7, 'fx_rate', {text('fx_rate')},
  CASE WHEN fx_rate IS NULL
       THEN 'fx_rate is required for non-USD currency ''' || currency || '''.'
       WHEN n IS NULL THEN 'Invalid fx_rate value: ''' || fx_rate || '''.'
       ELSE 'fx_rate ' || fx_rate || ' out of range [0.1, 500].' END
FROM (SELECT *, {fx} AS n FROM {table})
WHERE currency IN ('EUR', 'GBP', 'INR') AND (n IS NULL OR n < 0.1 OR n > 500)
UNION ALL
SELECT row_index, 8, 'employee_id', e,
  'Duplicate (employee_id, spend_date) pair ''' || e || ''', ''' || s
    || ''' — also at row ' || prev_row || '.'
FROM ({repeats(table)}) WHERE prev_row IS NOT NULL
"""


def repeats(table: str) -> str:
    """Every row with the index of the closest earlier row of the same pair."""
    return f"""SELECT row_index, e, s,
  lag(row_index) OVER (PARTITION BY e, s ORDER BY row_index) AS prev_row
FROM (SELECT row_index, {text('employee_id')} AS e, {text('spend_date')} AS s FROM {table})"""


def fingerprint(columns: tuple[str, ...]) -> str:
    """Digest over name-value pairs in name order."""
    pairs = [
        f"coalesce('{c}=' || CAST(length({c}) AS VARCHAR) || ':' || {c}, '{c}~')"
        for c in sorted(columns)
    ]
    return f"sha256({' || '.join(pairs)})"


def with_x(**ctes: str) -> str:
    """``WITH x AS (the expense view), name AS (...), …``."""
    named = [f"x AS ({X})"] + [f"{name} AS ({sql})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(named) + "\n"


# Sample fixes over the expense table; seq is unique; row_index is text as a person types it.
FIXES = """
SELECT row_index * 10 AS seq, CAST(row_index AS STRING) AS row_index, 'dept' AS field,
  'HR' AS new_value FROM x WHERE dept = 'SALES'
UNION ALL
SELECT row_index * 10 + 1, CAST(row_index AS STRING), 'amount', 'abc' FROM x
WHERE amount = '-5'
UNION ALL
SELECT row_index * 10 + 2, CAST(row_index AS STRING), 'amount', '5' FROM x WHERE amount = '-5'
UNION ALL
SELECT row_index * 10 + 3, ' ' || CAST(row_index AS STRING), 'currency', 'USD' FROM x
WHERE currency = 'JPY'
UNION ALL
SELECT row_index * 10 + 4, CAST(row_index AS STRING), 'spend_date',
  substr(spend_date, 7, 4) || '-' || substr(spend_date, 1, 2) || '-' || substr(spend_date, 4, 2)
FROM x WHERE spend_date LIKE '%/%'
UNION ALL
SELECT row_index * 10 + 5, CAST(row_index AS STRING), 'vendor', 'Vendor UNKNOWN' FROM x
WHERE vendor = ''
UNION ALL
SELECT row_index * 10 + 6, CAST(row_index AS STRING), 'vendor', CAST(NULL AS STRING) FROM x
WHERE vendor = '   '
UNION ALL
SELECT row_index * 10 + 7, CAST(row_index AS STRING), 'note', 'check id' FROM x
WHERE employee_id LIKE 'emp%'
UNION ALL
SELECT row_index * 10 + 8, 'row ' || CAST(row_index AS STRING), 'dept', 'HR' FROM x
WHERE amount = 'n/a'
UNION ALL
SELECT row_index * 10 + 9, '9' || lpad(CAST(row_index AS STRING), 14, '0'), 'dept', 'HR'
FROM x WHERE fx_rate = 'abc'
"""
# The part of FIXES that can be applied.
GOOD_FIXES = f"""
SELECT seq, try_cast(row_index AS BIGINT) AS row_index, field, new_value
FROM ({FIXES}) WHERE row_index NOT LIKE 'row %' AND length(row_index) < 15
"""


def fixed(table: str = "x", fixes: str = "f") -> str:
    """The table with the last fix of every cell laid over it."""
    columns = ("employee_id", "dept", "amount", "currency", "spend_date", "vendor", "fx_rate")
    cells = ",\n  ".join(
        f"CASE WHEN k_{c} IS NOT NULL THEN v_{c} ELSE {c} END AS {c}" for c in columns
    )
    last = ",\n  ".join(
        f"max(CASE WHEN field = '{c}' THEN seq END) AS k_{c},"
        f" arg_max_null(new_value, CASE WHEN field = '{c}' THEN seq END) AS v_{c}"
        for c in (*columns, "note")
    )
    return f"""SELECT t.row_index, {cells},
  CASE WHEN k_note IS NOT NULL THEN v_note END AS note
FROM {table} t LEFT JOIN (SELECT row_index, {last} FROM {fixes} GROUP BY row_index) o
  ON t.row_index = o.row_index"""
