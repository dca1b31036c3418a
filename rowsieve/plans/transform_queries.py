"""Queries over added columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import RunConfig
from rowsieve.operators import transform
from rowsieve.plans import twins
from rowsieve.plans.registry import query
from rowsieve.plans.rule_queries import LINE_KEY
from rowsieve.sources.tables import EXPENSE_AS_OF, expenses, table

CONFIG = RunConfig(as_of=EXPENSE_AS_OF)
OVERLAID = RunConfig(as_of=EXPENSE_AS_OF, cost_center_map={"OPS": "450", "SALES": "500"})
REGIONS = {"EUR": "Europe", "GBP": "Britain", "INR": "India"}

AMOUNT = f"coalesce({twins.number('amount', 'DECIMAL(18,6)')}, 0)"
RATE = f"coalesce({twins.number('fx_rate', 'DECIMAL(18,6)')}, 1)"
PRODUCT = f"CAST({AMOUNT} AS DECIMAL(20,6)) * CAST({RATE} AS DECIMAL(18,6))"
USD = f"CAST(round({PRODUCT}, 2) AS DECIMAL(18,2))"
USD_WHOLE = f"CAST(round({PRODUCT}, 0) AS DECIMAL(18,2))"
CENTER = (
    "CASE dept WHEN 'FIN' THEN '100' WHEN 'HR' THEN '200' WHEN 'ENG' THEN '300'"
    " WHEN 'OPS' THEN '400' ELSE 'UNMAPPED' END"
)
APPROVAL = f"CASE WHEN dept = 'FIN' AND {AMOUNT} > 50000 THEN 'YES' ELSE 'NO' END"
ENRICHED = f"""SELECT *, {USD} AS amount_usd, {CENTER} AS cost_center,
  {APPROVAL} AS approval_required FROM x"""


@query(
    "lookup_column",
    twins.with_x()
    + """SELECT row_index, CASE currency WHEN 'EUR' THEN 'Europe' WHEN 'GBP' THEN 'Britain'
  WHEN 'INR' THEN 'India' ELSE 'elsewhere' END AS region FROM x""",
)
def lookup_column(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    return transform.lookup_column(x, "region", "currency", REGIONS, "elsewhere").select(
        "row_index", "region"
    )


@query(
    "lookup_missing_source",
    twins.with_x() + "SELECT row_index, 'UNMAPPED' AS region FROM x",
)
def lookup_missing_source(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    return transform.lookup_column(x, "region", "no_such_column", REGIONS).select(
        "row_index", "region"
    )


LOOKUP_JOIN = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  coalesce(m.map_value, 'UNMAPPED') AS brand
FROM lineitem LEFT JOIN (
  SELECT CAST(p_partkey AS VARCHAR) AS map_key, p_brand AS map_value FROM part
  WHERE p_brand <> 'Brand#7') m ON CAST(l_partkey AS VARCHAR) = m.map_key"""


def _brands(spark, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_brand") != "Brand#7")
        .select(F.col("p_partkey").cast("string").alias("map_key"), "p_brand")
        .withColumnRenamed("p_brand", "map_value")
    )


@query("lookup_join", LOOKUP_JOIN)
def lookup_join(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    joined = transform.lookup_table_column(
        lines, "brand", "l_partkey", _brands(spark, sf_dir), row_key=LINE_KEY
    )
    return joined.select(*LINE_KEY, "brand")


@query(
    "lookup_null_value",
    twins.with_x()
    + """SELECT row_index, CASE WHEN dept = 'FIN' THEN NULL WHEN dept = 'HR' THEN '200'
  ELSE 'UNMAPPED' END AS from_literal, CASE WHEN dept = 'FIN' THEN NULL WHEN dept = 'HR' THEN '200'
  ELSE 'UNMAPPED' END AS from_table FROM x""",
)
def lookup_null_value(spark, sf_dir: str) -> DataFrame:
    """A key mapped to null gives null, whether the map is in the plan or in a table."""
    mapping = {"FIN": None, "HR": "200"}
    rows = spark.createDataFrame(list(mapping.items()), "map_key string, map_value string")
    x = transform.lookup_column(expenses(spark, sf_dir), "from_literal", "dept", mapping)
    both = transform.lookup_table_column(x, "from_table", "dept", rows)
    return both.select("row_index", "from_literal", "from_table")


@query(
    "lookup_repeated_keys",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  coalesce(m.map_value, 'UNMAPPED') AS cheapest
FROM lineitem LEFT JOIN (
  SELECT o_orderstatus AS map_key, min(o_orderpriority) AS map_value FROM orders GROUP BY 1) m
ON l_linestatus = m.map_key""",
)
def lookup_repeated_keys(spark, sf_dir: str) -> DataFrame:
    """A map with many values for a key: rows keep their number, the smallest value counts."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_linestatus")
    entries = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("map_key"), F.col("o_orderpriority").alias("map_value")
    )
    joined = transform.lookup_table_column(
        lines, "cheapest", "l_linestatus", entries, row_key=LINE_KEY
    )
    return joined.select(*LINE_KEY, "cheapest")


@query(
    "lookup_join_salted",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  coalesce(m.map_value, 'UNMAPPED') AS flag_orders
FROM lineitem LEFT JOIN (
  SELECT o_orderstatus AS map_key, CAST(count(*) AS VARCHAR) AS map_value
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) m ON l_linestatus = m.map_key""",
)
def lookup_join_salted(spark, sf_dir: str) -> DataFrame:
    """The map counts as too large to broadcast and two keys hold all rows: salted join."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_linestatus")
    counts = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") != "P")
        .groupBy(F.col("o_orderstatus").alias("map_key"))
        .agg(F.count("*").cast("string").alias("map_value"))
    )
    joined = transform.lookup_table_column(
        lines, "flag_orders", "l_linestatus", counts, row_key=LINE_KEY,
        broadcast_rows=0, piece_rows=2_000,
    )
    return joined.select(*LINE_KEY, "flag_orders")


@query(
    "expression_column",
    twins.with_x()
    + f"""SELECT row_index, CAST(n * 2 AS DECIMAL(20,6)) AS doubled,
  CASE WHEN n IS NULL THEN
    'ERROR: no value for CAST(try_cast(amount AS decimal(18,6)) * 2 AS decimal(20,6))'
  END AS doubled_error
FROM (SELECT row_index, {twins.number('amount', 'DECIMAL(18,6)')} AS n FROM x)""",
)
def expression_column(spark, sf_dir: str) -> DataFrame:
    expression = "CAST(try_cast(amount AS decimal(18,6)) * 2 AS decimal(20,6))"
    added = transform.transform_column(
        expenses(spark, sf_dir), "doubled", expression=expression
    )
    return added.select("row_index", "doubled", "doubled_error")


@query(
    "expression_column_native",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(10,0)), 1)
    AS DECIMAL(18,1)) AS gross FROM lineitem""",
)
def expression_column_native(spark, sf_dir: str) -> DataFrame:
    added = transform.transform_column(
        table(spark, sf_dir, "lineitem"),
        "gross",
        expression="CAST(round(CAST(l_extendedprice AS decimal(18,2))"
        " * CAST(l_quantity AS decimal(10,0)), 1) AS decimal(18,1))",
    )
    return added.select(*LINE_KEY, "gross")


@query("static_column", twins.with_x() + "SELECT row_index, 'Q2' AS period FROM x")
def static_column(spark, sf_dir: str) -> DataFrame:
    x = expenses(spark, sf_dir)
    return transform.transform_column(x, "period", default_value="Q2").select(
        "row_index", "period"
    )


@query(
    "replace_column",
    twins.with_x() + "SELECT row_index, employee_id, 'EUR' AS currency FROM x",
)
def replace_column(spark, sf_dir: str) -> DataFrame:
    """A name the table already has is replaced in place."""
    x = expenses(spark, sf_dir)
    return transform.transform_column(x, "currency", default_value="EUR").select(
        "row_index", "employee_id", "currency"
    )


def _computed(name: str, sql: str, column: str, config: RunConfig = CONFIG) -> None:
    @query(name, twins.with_x() + f"SELECT row_index, {sql} AS {column} FROM x")
    def build(spark, sf_dir: str) -> DataFrame:
        return transform.enrich(expenses(spark, sf_dir), config).select("row_index", column)


_computed("amount_usd", USD, "amount_usd")
_computed(
    "amount_usd_whole",
    USD_WHOLE,
    "amount_usd",
    RunConfig(as_of=EXPENSE_AS_OF, usd_rounding="whole"),
)
_computed("cost_center", CENTER, "cost_center")
_computed(
    "cost_center_overlaid",
    "CASE dept WHEN 'FIN' THEN '100' WHEN 'HR' THEN '200' WHEN 'ENG' THEN '300'"
    " WHEN 'OPS' THEN '450' WHEN 'SALES' THEN '500' ELSE 'UNMAPPED' END",
    "cost_center",
    OVERLAID,
)
_computed("approval_required", APPROVAL, "approval_required")


@query("enrich_all", twins.with_x() + ENRICHED)
def enrich_all(spark, sf_dir: str) -> DataFrame:
    return transform.enrich(expenses(spark, sf_dir), CONFIG)


@query("enrich_twice", twins.with_x() + ENRICHED)
def enrich_twice(spark, sf_dir: str) -> DataFrame:
    once = transform.enrich(expenses(spark, sf_dir), CONFIG)
    return transform.enrich(once, CONFIG)


@query(
    "amount_usd_native",
    """SELECT r.r_name AS region, CAST(sum(CAST(round(CAST(o_totalprice AS DECIMAL(18,6))
  * CAST('1.08' AS DECIMAL(18,6)), 2) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS usd
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region r ON n_regionkey = r_regionkey GROUP BY r.r_name""",
)
def amount_usd_native(spark, sf_dir: str) -> DataFrame:
    """The money column on the order table itself, summed per region."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_totalprice").alias("amount"), F.lit("1.08").alias("fx_rate")
    )
    priced = orders.withColumn("amount_usd", transform.amount_usd(orders))
    return (
        priced.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.sum("amount_usd").cast("decimal(28,2)").alias("usd"))
    )
