"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.tokens import encoder
from rowsieve.session import settle

#: Lengths in one stretch of the two-level suffix sums.
STRETCH = 4096


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens) of each row of ``docs``; a null or empty text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            ids = tool.encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.record_batch([pa.array([len(i) // 4 for i in ids], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many rows have each length. Summed before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_table(histogram: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """What every context limit keeps, one row for each length that occurs.

    ``docs_at_least`` and ``tokens_at_least`` sum the lengths from ``n_tokens`` on;
    ``truncated_tokens`` is the total if every document is cut at ``n_tokens``;
    ``share_within`` is the share of documents no longer than it (their quantile).

    Two levels: sums of stretches of lengths are added up in one small window, lengths inside
    a stretch in a window of their own; neither grows with the number of documents. An empty
    table gives no rows. Rows with a null length are left out.
    """
    rows = histogram.filter(F.col("n_tokens").isNotNull()).withColumn(
        "stretch", F.floor(F.col("n_tokens") / stretch)
    )
    tokens = F.col("n_tokens") * F.col("n_docs")
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("stretch")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    every = Window.partitionBy(F.lit(0))
    stretches = (
        rows.groupBy("stretch")
        .agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
        .select(
            "stretch",
            F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("later_docs"),
            F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("later_tokens"),
            F.sum("docs").over(every).alias("all_docs"),
            F.sum("tokens").over(every).alias("all_tokens"),
        )
    )
    here = Window.partitionBy("stretch").orderBy(F.desc("n_tokens"))
    docs_at_least = F.sum("n_docs").over(here) + F.col("later_docs")
    tokens_at_least = F.sum(tokens).over(here) + F.col("later_tokens")
    return (
        rows.join(stretches, "stretch")
        .select(
            "n_tokens",
            "n_docs",
            docs_at_least.alias("docs_at_least"),
            tokens_at_least.alias("tokens_at_least"),
            "all_docs",
            "all_tokens",
        )
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (
                F.col("all_tokens")
                - F.col("tokens_at_least")
                + F.col("docs_at_least") * F.col("n_tokens")
            ).alias("truncated_tokens"),
            (
                (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
            ).alias("share_within"),
        )
    )


def answer_limits(suffixes: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_cut, truncated_tokens) for any limits, from the suffix table.

    The next length at or above a limit holds all longer documents; below it nothing is cut.
    ``limits`` is a parameter, so the join side that is sent out is as long as that list.
    """
    spark = suffixes.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    above = F.col("n_tokens") > F.col("context_limit")
    below = F.col("n_tokens") <= F.col("context_limit")
    return (
        suffixes.join(F.broadcast(asked))
        .groupBy("context_limit")
        .agg(
            F.coalesce(F.min_by(F.when(above, F.col("docs_at_least")),
                                F.when(above, F.col("n_tokens"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(F.sum(F.when(below, F.col("n_tokens") * F.col("n_docs"))), F.lit(0))
            .alias("whole_tokens"),
        )
        .select(
            "context_limit",
            "docs_cut",
            (F.col("whole_tokens") + F.col("docs_cut") * F.col("context_limit")).alias(
                "truncated_tokens"
            ),
        )
    )


def length_quantiles(suffixes: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the shortest length that at least this share of documents keep to."""
    spark = suffixes.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return (
        suffixes.join(F.broadcast(asked), F.col("share_within") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The suffix table of all documents. Texts are encoded once, whole; extra columns are not
    read. Repeated rows count each time; null and empty texts have length 0."""
    return suffix_table(settle(length_histogram(token_lengths(docs, tokenizer)), "lengths"))
