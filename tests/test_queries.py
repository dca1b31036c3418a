"""All registered queries: plan shape, and equality with their SQL twins on the small tables."""

import os

import duckdb
import pytest

from check import TABLES, compare
from rowsieve.operators import validate
from rowsieve.plans import catalog
from rowsieve.sources.tables import expenses
from tests.helpers import RULES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


# One or two of each area; ``python check.py`` runs them all.
SAMPLE = (
    "rule_amount rule_unique rule_unique_hot_native error_ledger error_ledger_with_skips"
    " validation_summary review_batch incremental_validate cache_rewrite refresh_ledger"
    " lookup_join_salted enrich_all apply_fixes fix_audit apply_answers skip_all_active"
    " error_rows error_reasons_two_passes review_sessions_hot run_stale_guard_hot csv_round_trip"
    " header_row workbook_round_trip run_to_errors stream_ledger stream_sessions"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    verdict = compare(spark, SF_DIR, name, con)
    assert verdict.startswith("ok"), verdict


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [n for n, q in catalog.QUERIES.items()
     if q.__module__.endswith(("rule_queries", "transform_queries"))],
)
def test_no_cross_joins(spark, name):
    plan = physical(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_rules_need_no_shuffle(spark):
    x = expenses(spark, SF_DIR)
    assert "Exchange hashpartitioning" not in physical(validate.row_errors(x, RULES))


def test_duplicate_check_reads_only_its_columns(spark, tmp_path):
    expenses(spark, SF_DIR).write.parquet(str(tmp_path / "x"))
    landed = spark.read.parquet(str(tmp_path / "x"))
    plan = physical(validate.repeated_rows(landed, RULES.unique.columns))
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert schema == "struct<row_index:bigint,employee_id:string,spend_date:string>"
    assert plan.count("Exchange") == 1


def test_static_rules_do_not_run_python(spark):
    plan = physical(validate.error_ledger(expenses(spark, SF_DIR), RULES))
    assert "Python" not in plan and "Pandas" not in plan
