"""Declarative rules.

A row rule is a pair of column expressions, ``violation`` and ``message``, so a whole
rule set compiles into one generated projection. The unique rule is the only one that
looks at other rows and is evaluated by :mod:`rowsieve.operators.validate`.
New rules are added by subclassing :class:`RowRule`; the engine needs no change.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.config import RunConfig
from rowsieve.functions.text import as_date, as_number, is_blank, render, shown


class Cells:
    """Access to the cells of a row; a column the table lacks reads as a literal.

    Text is parsed under a guard; columns that already have the type are used as they are.
    """

    def __init__(self, df: DataFrame) -> None:
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def __call__(self, name: str, absent: str | None = "") -> Column:
        return F.col(name) if name in self._types else F.lit(absent).cast("string")

    def number(self, name: str, absent: str | None) -> Column:
        if isinstance(self._types.get(name), T.NumericType):
            return F.col(name).cast("double")
        return as_number(self(name, absent))

    def date(self, name: str) -> Column:
        if isinstance(self._types.get(name), (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(name).cast("date")
        return as_date(self(name))


@dataclass(frozen=True)
class RowRule:
    """Zero or one error per row, decided from that row alone.

    ``parsed`` names the typed value of the cell, if the rule needs one. It is computed in
    a projection of its own, so each cell is parsed once however often it is compared.
    """

    rule_no: int
    field: str

    @property
    def value(self) -> Column:
        return F.col(f"_value_{self.rule_no}")

    def parsed(self, cells: Cells) -> Column | None:
        return None

    def violation(self, cells: Cells) -> Column:
        raise NotImplementedError

    def message(self, cells: Cells) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class PatternRule(RowRule):
    """The cell text must match ``pattern``; null never matches."""

    pattern: str
    text: str

    def violation(self, cells: Cells) -> Column:
        return F.coalesce(~cells(self.field).cast("string").rlike(self.pattern), F.lit(True))

    def message(self, cells: Cells) -> Column:
        return render(self.text, value=shown(cells(self.field)))


@dataclass(frozen=True)
class AllowedRule(RowRule):
    """The cell must be one of ``values`` (case-sensitive)."""

    values: tuple[str, ...]
    text: str

    def violation(self, cells: Cells) -> Column:
        return F.coalesce(~cells(self.field).cast("string").isin(*self.values), F.lit(True))

    def message(self, cells: Cells) -> Column:
        return render(self.text, value=shown(cells(self.field)))


@dataclass(frozen=True)
class RangeRule(RowRule):
    """The cell must be a number in the given range; ``low_open`` excludes the lower bound."""

    low: float
    high: float
    low_open: bool
    range_text: str
    invalid_text: str

    def parsed(self, cells: Cells) -> Column:
        return cells.number(self.field, absent="0")

    def violation(self, cells: Cells) -> Column:
        too_low = self.value <= self.low if self.low_open else self.value < self.low
        return self.value.isNull() | too_low | (self.value > self.high)

    def message(self, cells: Cells) -> Column:
        value = shown(cells(self.field, absent="0"))
        return F.when(self.value.isNull(), render(self.invalid_text, value=value)).otherwise(
            render(self.range_text, value=value)
        )


@dataclass(frozen=True)
class DateRule(RowRule):
    """The cell must be a YYYY-MM-DD date not after ``as_of``."""

    as_of: dt.date
    future_text: str
    invalid_text: str

    def parsed(self, cells: Cells) -> Column:
        return cells.date(self.field)

    def violation(self, cells: Cells) -> Column:
        return self.value.isNull() | (self.value > F.lit(self.as_of))

    def message(self, cells: Cells) -> Column:
        value = shown(cells(self.field))
        return F.when(self.value.isNull(), render(self.invalid_text, value=value)).otherwise(
            render(self.future_text, value=value)
        )


@dataclass(frozen=True)
class NotBlankRule(RowRule):
    """The cell must hold more than white space.

    ``null_text_passes`` lets a null through, for callers that treat it as the word "None".
    """

    text: str
    null_text_passes: bool = False

    def violation(self, cells: Cells) -> Column:
        return F.coalesce(is_blank(cells(self.field)), F.lit(not self.null_text_passes))

    def message(self, cells: Cells) -> Column:
        return F.lit(self.text)


@dataclass(frozen=True)
class RequiredWhenRule(RowRule):
    """When ``when_field`` holds one of ``when_values``, the cell must be a number in range."""

    when_field: str
    when_values: tuple[str, ...]
    low: float
    high: float
    required_text: str
    range_text: str
    invalid_text: str

    def parsed(self, cells: Cells) -> Column:
        return cells.number(self.field, absent=None)

    def violation(self, cells: Cells) -> Column:
        held = cells(self.when_field).cast("string")
        applies = F.coalesce(held.isin(*self.when_values), F.lit(False))
        return applies & (
            self.value.isNull() | (self.value < self.low) | (self.value > self.high)
        )

    def message(self, cells: Cells) -> Column:
        cell = cells(self.field, absent=None)
        return (
            F.when(cell.isNull(), render(self.required_text, other=shown(cells(self.when_field))))
            .when(self.value.isNull(), render(self.invalid_text, value=shown(cell)))
            .otherwise(render(self.range_text, value=shown(cell)))
        )


@dataclass(frozen=True)
class UniqueRule:
    """Every row but the first with the same ``columns`` is an error on ``field``."""

    rule_no: int
    field: str
    columns: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class RuleSet:
    """Row rules in ledger order plus an optional unique rule."""

    row_rules: tuple[RowRule, ...]
    unique: UniqueRule | None = None

    @property
    def size(self) -> int:
        """The largest number of errors one row can have."""
        return len(self.row_rules) + (1 if self.unique else 0)

    def digest(self) -> str:
        """Changes with any rule or bound, the cut-off day included; keys the cache."""
        text = repr((self.row_rules, self.unique))
        return hashlib.sha256(text.encode()).hexdigest()

    def only(self, *rule_nos: int) -> RuleSet:
        """The rule set cut down to the row rules with these numbers."""
        return RuleSet(tuple(r for r in self.row_rules if r.rule_no in rule_nos))

    def with_parsed(self, df: DataFrame) -> DataFrame:
        """Add the typed side columns the rules compare."""
        cells = Cells(df)
        typed = {f"_value_{r.rule_no}": r.parsed(cells) for r in self.row_rules}
        return df.withColumns({name: col for name, col in typed.items() if col is not None})

    def errors(self, df: DataFrame) -> Column:
        """One entry per row rule, null where the row passes; ``df`` is from with_parsed."""
        cells = Cells(df)
        return F.array(
            *[
                F.when(
                    rule.violation(cells),
                    F.struct(
                        F.lit(rule.rule_no).alias("rule_no"),
                        F.lit(rule.field).alias("field"),
                        shown(cells(rule.field)).alias("current_value"),
                        rule.message(cells).alias("error_message"),
                    ),
                )
                for rule in self.row_rules
            ]
        )

    def passes(self, df: DataFrame) -> Column:
        """True when no row rule is broken; ``df`` is from with_parsed."""
        cells = Cells(df)
        broken = F.lit(False)
        for rule in self.row_rules:
            broken = broken | rule.violation(cells)
        return ~broken


# --- fixed values -----------------------------------------------------------
DEPARTMENTS = ("ENG", "FIN", "HR", "OPS")
CURRENCIES = ("EUR", "GBP", "INR", "USD")
HOME_CURRENCY = "USD"
EMPLOYEE_PATTERN = r"^[A-Z0-9]{4,12}\z"
EMPLOYEE_TEXT = (
    "Invalid employee_id format: '{value}'. Must be 4-12 alphanumeric characters (A-Z, 0-9)."
)
DEPARTMENT_TEXT = "Invalid department '{value}'. Must be one of: ['ENG', 'FIN', 'HR', 'OPS']."
AMOUNT_RANGE_TEXT = "Amount {value} out of range. Must be > 0 and <= 100,000."
AMOUNT_INVALID_TEXT = "Invalid amount value: '{value}'."
CURRENCY_TEXT = "Invalid currency '{value}'. Must be one of: ['EUR', 'GBP', 'INR', 'USD']."
FUTURE_TEXT = "Future date '{value}' not allowed."
DATE_INVALID_TEXT = "Invalid date format '{value}'. Must be YYYY-MM-DD."
VENDOR_TEXT = "Vendor must not be empty."
FX_REQUIRED_TEXT = "fx_rate is required for non-USD currency '{other}'."
FX_RANGE_TEXT = "fx_rate {value} out of range [0.1, 500]."
FX_INVALID_TEXT = "Invalid fx_rate value: '{value}'."
DUPLICATE_TEXT = (
    "Duplicate (employee_id, spend_date) pair '{employee_id}', '{spend_date}'"
    " — also at row {previous}."
)
# --- end of fixed values ----------------------------------------------------


def expense_rules(config: RunConfig, null_text_passes: bool = False) -> RuleSet:
    """The default rule set: eight checks on an expense table."""
    foreign = tuple(c for c in CURRENCIES if c != HOME_CURRENCY)
    return RuleSet(
        row_rules=(
            PatternRule(1, "employee_id", EMPLOYEE_PATTERN, EMPLOYEE_TEXT),
            AllowedRule(2, "dept", DEPARTMENTS, DEPARTMENT_TEXT),
            RangeRule(
                3, "amount", 0.0, 100000.0, True, AMOUNT_RANGE_TEXT, AMOUNT_INVALID_TEXT
            ),
            AllowedRule(4, "currency", CURRENCIES, CURRENCY_TEXT),
            DateRule(5, "spend_date", config.cutoff, FUTURE_TEXT, DATE_INVALID_TEXT),
            NotBlankRule(6, "vendor", VENDOR_TEXT, null_text_passes),
            RequiredWhenRule(
                7,
                "fx_rate",
                "currency",
                foreign,
                0.1,
                500.0,
                FX_REQUIRED_TEXT,
                FX_RANGE_TEXT,
                FX_INVALID_TEXT,
            ),
        ),
        unique=UniqueRule(8, "employee_id", ("employee_id", "spend_date"), DUPLICATE_TEXT),
    )
