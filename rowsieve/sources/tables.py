"""The driver's parquet tables and the expense view derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
# The same text runs in Spark SQL and in DuckDB. ``{orders}`` and friends are filled in.
EXPENSE_VIEW = """
SELECT o_orderkey AS row_index,
  CASE WHEN o_orderkey % 41 = 0 THEN 'emp' || CAST(o_custkey AS STRING)
       ELSE 'EMP' || lpad(CAST(o_custkey AS STRING), 6, '0') END AS employee_id,
  CASE WHEN o_orderkey % 37 = 0 THEN 'SALES'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'FIN' WHEN c_mktsegment = 'FURNITURE' THEN 'HR'
       WHEN c_mktsegment = 'BUILDING' THEN 'OPS' ELSE 'ENG' END AS dept,
  CASE WHEN o_orderkey % 53 = 0 THEN '-5' WHEN o_orderkey % 59 = 0 THEN 'n/a'
       ELSE CAST(CAST(floor(o_totalprice / 4) AS BIGINT) AS STRING) || '.'
            || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') END AS amount,
  CASE WHEN o_orderkey % 43 = 0 THEN 'JPY' WHEN n_regionkey = 1 THEN 'EUR'
       WHEN n_regionkey = 2 THEN 'GBP' WHEN n_regionkey = 3 THEN 'INR' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 47 = 0
       THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/'
            || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/'
            || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS spend_date,
  CASE WHEN o_orderkey % 61 = 0 THEN '' WHEN o_orderkey % 67 = 0 THEN '   '
       WHEN o_orderkey % 71 = 0 THEN NULL ELSE 'Vendor ' || n_name END AS vendor,
  CASE WHEN o_orderkey % 73 = 0 THEN NULL WHEN o_orderkey % 79 = 0 THEN '0.01'
       WHEN o_orderkey % 83 = 0 THEN 'abc' WHEN n_regionkey = 1 THEN '1.08'
       WHEN n_regionkey = 2 THEN '1.27' WHEN n_regionkey = 3 THEN '83.1' ELSE '1.0' END AS fx_rate
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
EXPENSE_AS_OF = "2001-06-30"
# --- end of fixed values ----------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expenses(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The expense table: seven text columns and a dense ``row_index``."""
    return spark.sql(
        EXPENSE_VIEW,
        orders=table(spark, sf_dir, "orders") if orders is None else orders,
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
    )
