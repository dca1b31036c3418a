import random

import pytest
from pyspark.sql import functions as F

from rowsieve.operators import groups
from rowsieve.operators.groups import if_small, lookup_join, ranged_pieces, value_before
from tests.helpers import collect


def rows_with_a_hot_key(n, seed):
    """A third of all rows share one key, another part has a null key."""
    pick = random.Random(seed)
    keys = ["hot"] * (n // 3) + [None] * (n // 6)
    keys += [f"k{pick.randrange(n)}" for _ in range(n - len(keys))]
    pick.shuffle(keys)
    return [(i, k, pick.choice([None, i * 10])) for i, k in enumerate(keys)]


def brute_force(rows, skip_nulls):
    last, out = {}, []
    for i, k, v in rows:
        out.append((i, last.get(k)))
        if v is not None or not skip_nulls:
            last[k] = v
    return sorted(out, key=repr)


@pytest.mark.parametrize("skip_nulls", [False, True])
@pytest.mark.parametrize("piece_rows", [1_000_000, 50, 7])
def test_value_before_equals_brute_force(spark, skip_nulls, piece_rows):
    rows = rows_with_a_hot_key(600, 5)
    df = spark.createDataFrame(rows, "i bigint, k string, v bigint").repartition(6)
    got = value_before(
        df, ["k"], "i", F.col("v"), "prev", skip_nulls=skip_nulls, piece_rows=piece_rows
    )
    assert collect(got, "i", "prev") == brute_force(rows, skip_nulls)


def test_only_a_hot_key_is_cut_by_rank(spark, monkeypatch):
    # Any table of more than a piece was ranged, written and joined, however small its keys were.
    cut = []
    monkeypatch.setattr(
        groups, "ranged_pieces", lambda *args: cut.append(1) or ranged_pieces(*args)
    )
    rows = [(i, f"k{i % 40}" if i % 40 else None, i * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "i bigint, k string, v bigint").repartition(6)
    got = value_before(df, ["k"], "i", F.col("v"), "prev", piece_rows=10)
    assert collect(got, "i", "prev") == brute_force(rows, False) and not cut
    got = value_before(df, ["k"], "i", F.col("v"), "prev", piece_rows=9)
    assert collect(got, "i", "prev") == brute_force(rows, False) and cut


@pytest.mark.parametrize("order", ["sparse", "dense", "equal"])
def test_pieces_of_a_hot_key_have_one_size(spark, order):
    # Three quarters of the rows share a key; gaps of the order grow, are 1, or there are none.
    place = {"sparse": lambda i: i**3, "dense": lambda i: i, "equal": lambda i: 5}[order]
    rows = [(place(i), "hot" if i % 4 else f"k{i}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "i bigint, k string, v bigint")
    pieces = ranged_pieces(df, ["k"], "i", F.col("v"), "prev", False, 4000, 400)
    sizes = [r["count"] for r in pieces.groupBy("_piece").count().collect()]
    assert len(sizes) >= 8 and sum(sizes) == 4000 and max(sizes) <= 700
    got = value_before(df, ["k"], "i", F.col("v"), "prev", piece_rows=400)
    if order != "equal":
        assert collect(got, "v", "prev") == brute_force([(v, k, v) for _, k, v in rows], False)
    else:  # any order, but one: every row but the last is before exactly one other
        seen = [r["prev"] for r in got.filter("k = 'hot'").collect()]
        assert seen.count(None) == 1 and len(set(seen)) == 3000


def test_values_of_any_type_pass_over_empty_pieces(spark):
    rows = [(i, None if i % 3 else "x", (i % 7, [f"v{i}"]) if i in (4, 90) else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, k string, v struct<a: int, b: array<string>>")
    got = value_before(df, ["k"], "i", F.col("v"), "prev", skip_nulls=True, piece_rows=10)
    want = brute_force(rows, True)
    assert sorted(((r["i"], r["prev"] and tuple(r["prev"])) for r in got.collect()), key=repr) == want


def test_a_small_table_is_a_plain_window(spark):
    df = spark.range(100).select(F.col("id").alias("i"), (F.col("id") % 50).alias("k"))
    got = value_before(df, ["k"], "i", F.col("i"), "prev")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("broadcast_rows", [1_000, 0])
def test_lookup_join_keeps_every_left_row(spark, broadcast_rows):
    rows = rows_with_a_hot_key(600, 8)
    left = spark.createDataFrame(rows, "i bigint, k string, v bigint")
    right = spark.createDataFrame(
        [("hot", "H")] + [(f"k{i}", f"V{i}") for i in range(0, 600, 2)], "k string, name string"
    )
    names = dict(collect(right))
    got = lookup_join(left, right, "k", ["i"], broadcast_rows, piece_rows=40)
    expected = sorted([(i, names.get(k)) for i, k, _ in rows], key=repr)
    assert collect(got, "i", "name") == expected


def test_salt_spreads_the_hot_key(spark):
    left = spark.range(1000).select(F.col("id").alias("i"), F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", "H")], "k string, name string")
    got = lookup_join(left, right, "k", ["i"], broadcast_rows=0, piece_rows=100)
    assert got.filter("name = 'H'").count() == 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_only_small_sides_are_marked_for_broadcast(spark):
    df = spark.range(10)
    small = if_small(df, 10)._jdf.queryExecution().logical().toString()
    large = if_small(df, 9)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()
    wide = df.select(F.lit("x" * 1000).alias("c"))
    assert "broadcast" not in if_small(wide, 10, 5_000)._jdf.queryExecution().logical().toString().lower()


def test_small_pieces_do_not_become_tasks(spark):
    # A task for each piece of 20 rows made 2,500 tasks of these rows, and ever more of more rows.
    df = spark.range(50_000).select(F.col("id").alias("i"), (F.col("id") % 700).alias("k"))
    pieces = ranged_pieces(df, ["k"], "i", F.col("i"), "prev", False, 50_000, 20)
    assert pieces.rdd.getNumPartitions() <= 100
    got = value_before(df, ["k"], "i", F.col("i"), "prev", piece_rows=20)
    assert got.count() == 50_000
    want = F.when(F.col("i") >= 700, F.col("i") - 700)
    assert got.filter(~F.col("prev").eqNullSafe(want)).count() == 0
