"""Queries over single rules: the expense rules, and generic rules on other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import RunConfig
from rowsieve.operators.rules import (
    AllowedRule,
    DateRule,
    NotBlankRule,
    PatternRule,
    RangeRule,
    RequiredWhenRule,
    RuleSet,
    expense_rules,
)
from rowsieve.operators.validate import duplicate_errors, repeated_rows, row_errors
from rowsieve.plans import twins
from rowsieve.plans.registry import query
from rowsieve.sources.tables import EXPENSE_AS_OF, expenses, table

CONFIG = RunConfig(as_of=EXPENSE_AS_OF)
RULES = expense_rules(CONFIG)


def _register_expense_rule(name: str, rule_no: int) -> None:
    oracle = twins.with_x(ledger=twins.ledger("x")) + (
        "SELECT row_index, field, current_value, error_message FROM ledger"
        f" WHERE rule_no = {rule_no}"
    )

    @query(name, oracle)
    def build(spark, sf_dir: str) -> DataFrame:
        return row_errors(expenses(spark, sf_dir), RULES.only(rule_no)).drop("rule_no")


for _name, _no in (
    ("rule_regex", 1),
    ("rule_enum_dept", 2),
    ("rule_amount", 3),
    ("rule_enum_currency", 4),
    ("rule_date", 5),
    ("rule_not_blank", 6),
    ("rule_fx", 7),
):
    _register_expense_rule(_name, _no)


@query(
    "rule_unique",
    twins.with_x(ledger=twins.ledger("x"))
    + "SELECT row_index, field, current_value, error_message FROM ledger WHERE rule_no = 8",
)
def rule_unique(spark, sf_dir: str) -> DataFrame:
    found = duplicate_errors(expenses(spark, sf_dir), RULES.unique)
    return found.select("row_index", "field", "current_value", "error_message")


@query(
    "rule_vendor_null_passes",
    twins.with_x()
    + "SELECT row_index, vendor AS current_value FROM x WHERE regexp_matches(vendor, '^\\s*$')",
)
def rule_vendor_null_passes(spark, sf_dir: str) -> DataFrame:
    lenient = expense_rules(CONFIG, null_text_passes=True).only(6)
    return row_errors(expenses(spark, sf_dir), lenient).select("row_index", "current_value")


@query(
    "rule_as_of_boundary",
    twins.with_x()
    + f"""SELECT row_index, spend_date AS current_value FROM x
WHERE ({twins.day('spend_date')}) > DATE '2001-06-29'""",
)
def rule_as_of_boundary(spark, sf_dir: str) -> DataFrame:
    """An earlier cut-off: the day itself passes, the next day is in the future."""
    early = expense_rules(RunConfig(as_of="2001-06-29")).only(5)
    found = row_errors(expenses(spark, sf_dir), early)
    future = F.col("error_message").startswith("Future")
    return found.filter(future).select("row_index", "current_value")


@query(
    "rule_regex_native",
    """SELECT p_partkey, p_brand AS current_value, 'Brand ' || p_brand || ' is not one digit.'
  AS error_message FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')""",
)
def rule_regex_native(spark, sf_dir: str) -> DataFrame:
    rule = PatternRule(1, "p_brand", r"^Brand#[0-9]\z", "Brand {value} is not one digit.")
    found = row_errors(table(spark, sf_dir, "part"), RuleSet((rule,)), ["p_partkey"])
    return found.select("p_partkey", "current_value", "error_message")


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "rule_range_native",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_extendedprice AS VARCHAR) AS current_value FROM lineitem
WHERE l_extendedprice <= 0 OR l_extendedprice > 100000""",
)
def rule_range_native(spark, sf_dir: str) -> DataFrame:
    rule = RangeRule(
        1, "l_extendedprice", 0.0, 100000.0, True, "{value} out of range.", "{value} is invalid."
    )
    found = row_errors(table(spark, sf_dir, "lineitem"), RuleSet((rule,)), LINE_KEY)
    return found.select(*LINE_KEY, "current_value")


@query(
    "rule_enum_native",
    """SELECT event_id, event_type AS current_value FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase')""",
)
def rule_enum_native(spark, sf_dir: str) -> DataFrame:
    rule = AllowedRule(1, "event_type", ("view", "click", "purchase"), "{value} not allowed.")
    found = row_errors(table(spark, sf_dir, "events"), RuleSet((rule,)), ["event_id"])
    return found.select("event_id", "current_value")


@query(
    "rule_not_after_native",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day FROM orders
WHERE CAST(o_orderdate AS DATE) > DATE '2000-12-31'""",
)
def rule_not_after_native(spark, sf_dir: str) -> DataFrame:
    day = RunConfig(as_of="2000-12-31").cutoff
    rule = DateRule(1, "o_orderdate", day, "{value} is too late.", "{value} is no date.")
    found = row_errors(table(spark, sf_dir, "orders"), RuleSet((rule,)), ["o_orderkey"])
    return found.select("o_orderkey", F.substring("current_value", 1, 10).alias("order_day"))


@query(
    "rule_not_blank_native",
    "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '^\\s*$')",
)
def rule_not_blank_native(spark, sf_dir: str) -> DataFrame:
    rule = NotBlankRule(1, "text", "The text is blank.")
    docs = table(spark, sf_dir, "documents")
    return row_errors(docs, RuleSet((rule,)), ["doc_id", "n_chars"]).select("doc_id", "n_chars")


@query(
    "rule_required_when_native",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_discount AS VARCHAR) AS current_value FROM lineitem
WHERE l_returnflag IN ('R', 'A') AND (l_discount < 0.02 OR l_discount > 0.08)""",
)
def rule_required_when_native(spark, sf_dir: str) -> DataFrame:
    rule = RequiredWhenRule(
        1, "l_discount", "l_returnflag", ("R", "A"), 0.02, 0.08,
        "A discount is required for {other}.", "{value} out of range.", "{value} is invalid.",
    )
    found = row_errors(table(spark, sf_dir, "lineitem"), RuleSet((rule,)), LINE_KEY)
    return found.select(*LINE_KEY, "current_value")


@query(
    "rule_unique_native",
    """SELECT o_orderkey, prev_row FROM (
  SELECT o_orderkey, lag(o_orderkey) OVER (
    PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS prev_row FROM orders)
WHERE prev_row IS NOT NULL""",
)
def rule_unique_native(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    repeats = repeated_rows(orders, ["o_custkey", "o_orderdate"], ["o_orderkey"])
    return repeats.select("o_orderkey", "prev_row")


@query(
    "rule_unique_hot_native",
    """SELECT event_id, prev_row FROM (
  SELECT event_id, lag(event_id) OVER (
    PARTITION BY event_type ORDER BY event_id) AS prev_row FROM events)
WHERE prev_row IS NOT NULL""",
)
def rule_unique_hot_native(spark, sf_dir: str) -> DataFrame:
    """Five keys hold all rows: every one of them is cut into pieces."""
    events = table(spark, sf_dir, "events")
    repeats = repeated_rows(events, ["event_type"], ["event_id"], piece_rows=1_000)
    return repeats.select("event_id", "prev_row")


@query(
    "rule_enum_typed",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 AS rule_no,
  'l_linenumber' AS field, CAST(l_linenumber AS VARCHAR) AS current_value,
  'line ' || l_linenumber || ' is not allowed' AS error_message
FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3)""",
)
def rule_enum_typed(spark, sf_dir: str) -> DataFrame:
    """Allowed values are compared as text, also on a column of whole numbers."""
    rules = RuleSet((AllowedRule(1, "l_linenumber", ("1", "2", "3"), "line {value} is not allowed"),))
    key = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return row_errors(table(spark, sf_dir, "lineitem").select(*key), rules, key)


@query(
    "rule_unique_sparse_order",
    """SELECT place, prev_place FROM (
  SELECT o_orderkey * o_orderkey AS place, lag(o_orderkey * o_orderkey) OVER (
    PARTITION BY o_orderstatus = 'P' ORDER BY o_orderkey) AS prev_place FROM orders)
WHERE prev_place IS NOT NULL""",
)
def rule_unique_sparse_order(spark, sf_dir: str) -> DataFrame:
    """Nearly all rows share a key, and their order values have ever wider gaps."""
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") * F.col("o_orderkey")).alias("place"),
        (F.col("o_orderstatus") == "P").cast("string").alias("is_p"),
    )
    repeats = repeated_rows(orders, ["is_p"], ["place"], piece_rows=1_000)
    return repeats.select("place", F.col("prev_row").alias("prev_place"))
