"""Text cells: display form, blank test and guarded parsing.

User text is never plain-cast: a guard pattern decides first, then ``try_cast``
runs, so ANSI mode cannot fail a job on a bad cell.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsieve.config import NA_WORDS

# --- fixed values -----------------------------------------------------------
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"
DATE_PATTERN = r"^[0-9]{4}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9])\z"
BLANK_PATTERN = r"(?U)^[\s\x1c-\x1f]*\z"
NULL_TEXT = "None"
# --- end of fixed values ----------------------------------------------------


def shown(cell: Column) -> Column:
    """The text a message prints for a cell; a null prints as ``None``."""
    return F.coalesce(cell.cast("string"), F.lit(NULL_TEXT))


def is_blank(cell: Column) -> Column:
    """True when nothing but (Unicode) white space is in the cell; null gives null."""
    return cell.cast("string").rlike(BLANK_PATTERN)


def as_number(cell: Column) -> Column:
    """Double value of a numeric text, else null."""
    text = cell.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def as_money(cell: Column) -> Column:
    """DECIMAL(18,6) value of a numeric text, else null (also when it does not fit)."""
    text = cell.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("decimal(18,6)"))


def as_date(cell: Column) -> Column:
    """Date of a YYYY-M-D text that exists in the calendar, else null."""
    text = cell.cast("string")
    well_formed = text.rlike(DATE_PATTERN) & ~text.startswith("0000-")
    return F.when(well_formed, text.try_cast("date"))


def na_to_null(cell: Column) -> Column:
    """Null for the words that mean "no value" in delimited files."""
    return F.when(~cell.isin(*NA_WORDS), cell)


def render(template: str, **cells: Column) -> Column:
    """Fill ``{name}`` places of a message template with columns."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(cells[name])
    return F.concat(*pieces)
