from decimal import Decimal

import pytest

from rowsieve.config import COST_CENTERS, RunConfig
from rowsieve.operators import transform
from rowsieve.operators.rules import DEPARTMENTS
from tests.helpers import CONFIG, collect, row, table


def column(df, name):
    return [r[name] for r in df.orderBy("row_index").collect()]


def test_lookup(spark):
    df = table(spark, [row(dept="FIN"), row(dept="HR"), row(dept=None)])
    assert column(transform.lookup_column(df, "c", "dept", {"FIN": "1", "None": "n"}), "c") == [
        "1", "UNMAPPED", "n",
    ]
    assert column(transform.lookup_column(df, "c", "dept", {}, "?"), "c") == ["?"] * 3
    assert column(transform.lookup_column(df, "c", "nowhere", {"FIN": "1"}), "c") == ["UNMAPPED"] * 3
    assert column(transform.lookup_column(df, "c", "dept", {"FIN": "1"}, None), "c") == [
        "1", None, None,
    ]


def test_large_map_is_joined(spark):
    df = table(spark, [row(vendor=f"v{i}") for i in (0, 1500, 9999)])
    mapping = {f"v{i}": str(i) for i in range(2000)}
    assert column(transform.lookup_column(df, "c", "vendor", mapping), "c") == [
        "0", "1500", "UNMAPPED",
    ]


def test_lookup_parameters_come_in_pairs(spark):
    df = table(spark, [row()])
    with pytest.raises(ValueError, match="lookup_map requires lookup_field"):
        transform.transform_column(df, "c", lookup_map={})
    with pytest.raises(ValueError, match="lookup_field requires lookup_map"):
        transform.transform_column(df, "c", lookup_field="dept")


def test_mode_order(spark):
    df = table(spark, [row()])
    both = transform.transform_column(
        df, "c", default_value="s", expression="'e'", lookup_field="dept", lookup_map={"ENG": "l"}
    )
    assert column(both, "c") == ["l"]
    assert column(transform.transform_column(df, "c", "s", "'e'"), "c") == ["e"]
    assert column(transform.transform_column(df, "c", "s"), "c") == ["s"]
    assert column(transform.transform_column(df, "c"), "c") == [None]


def test_expression_failure_is_reported_beside_the_value(spark):
    df = table(spark, [row(amount="12.5"), row(amount="abc")])
    out = transform.expression_column(df, "twice", "try_cast(amount AS double) * 2")
    assert column(out, "twice") == [25.0, None]
    assert column(out, "twice_error") == [None, "ERROR: no value for try_cast(amount AS double) * 2"]


def test_static_column_replaces_in_place(spark):
    df = table(spark, [row()])
    out = transform.static_column(df, "dept", "X")
    assert out.columns == df.columns and column(out, "dept") == ["X"]


AMOUNTS = [
    ("100", "1.08", "108.00"),
    ("100", None, "100.00"),
    (None, "2", "0.00"),
    ("abc", "2", "0.00"),
    ("2.675", "1", "2.68"),
    ("1.005", "1", "1.01"),
    ("50", "abc", "50.00"),
    ("-3", "2", "-6.00"),
    ("99999999999999", "1", "0.00"),
]


def test_amount_usd(spark):
    df = table(spark, [row(amount=a, fx_rate=r) for a, r, _ in AMOUNTS])
    assert column(transform.enrich(df, CONFIG), "amount_usd") == [Decimal(u) for *_, u in AMOUNTS]


def test_amount_usd_whole(spark):
    df = table(spark, [row(amount="2.5"), row(amount="2.49")])
    out = transform.enrich(df, RunConfig(usd_rounding="whole"))
    assert column(out, "amount_usd") == [Decimal("3.00"), Decimal("2.00")]
    with pytest.raises(ValueError):
        RunConfig(usd_rounding="dimes")


def test_cost_center_and_approval(spark):
    rows = [row(dept="FIN", amount="50001"), row(dept="FIN", amount="50000"),
            row(dept="HR", amount="90000"), row(dept="SALES"), row(dept=None)]
    out = transform.enrich(table(spark, rows), RunConfig(cost_center_map={"FIN": "111", "SALES": "5"}))
    assert column(out, "cost_center") == ["111", "111", "200", "5", "UNMAPPED"]
    assert column(out, "approval_required") == ["YES", "NO", "NO", "NO", "NO"]
    assert set(COST_CENTERS) == set(DEPARTMENTS)


def test_enrich_twice_changes_nothing(spark):
    once = transform.enrich(table(spark, [row(), row(dept="FIN", amount="60000")]), CONFIG)
    twice = transform.enrich(once, CONFIG)
    assert twice.columns == once.columns and collect(twice) == collect(once)


def test_enrich_without_the_columns(spark):
    df = spark.createDataFrame([(0, "x")], "row_index bigint, note string")
    got = transform.enrich(df, CONFIG).first()
    assert (got["amount_usd"], got["cost_center"], got["approval_required"]) == (
        Decimal("0.00"), "UNMAPPED", "NO",
    )
