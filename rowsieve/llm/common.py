"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.session import settle

#: White space between words; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def connected_components(edges: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """(node, component): the smallest node each node is connected to.

    Alternates large-star and small-star steps (each a grouped minimum and a join on the
    node) until the edges stop changing. Every step is written to the shared folder, so the
    plan stays short and a lost executor costs one re-read. Edges stay distributed; the driver
    sees a count and a checksum. Null nodes and loops are ignored.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    pairs = pairs.filter(F.col("u") != F.col("v"))
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = settle(pairs, f"{name}-edges")
    seen = _mark(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(
            small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(),
            f"{name}-edges",
        )
        mark = _mark(pairs)
        if mark == seen:
            break
        seen = mark
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])
