"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm import (
    jaccard_join,
    lexical_search,
    line_dedup,
    mixing,
    nearest,
    outlier_rules,
    packing,
    quality_qda,
    substring_dedup,
    token_counts,
    token_files,
    warc,
    whitening,
)
from rowsieve.llm.common import table
from rowsieve.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
END_ID = 2


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, the same result in SQL."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums over the lengths of all documents."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_path("byte_bpe_50k.json"))


@query("op3_source_mix")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the token id files."""
    docs = table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, public_path("word_bpe_49k.json"), END_ID)
    return token_files.read_token_files(files)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), END_ID)


@query("op1_line_dedup", line_dedup.oracle())
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).drop("source")


@query("op4_quality_qda")
def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_qda.scored(docs, table(spark, sf_dir, "labels"))
    return scored.drop("kept_row")


@query("op9_nearest", nearest.ORACLE)
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@query("op10_outlier_rules")
def op10_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the robust outlier verdict for every document."""
    return outlier_rules.judge(table(spark, sf_dir, "documents"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows leave of every document."""
    docs = table(spark, sf_dir, "documents")
    return substring_dedup.dedup_substrings(docs).drop("removed")


@query("op11_lexical_search", lexical_search.ORACLE)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical_search.search(docs, items)


@query("op12_warc", warc.ORACLE)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives it was written to."""
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.page_captures(warc.assemble(warc.read_archives(spark, folder, payloads=False)))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four components, whitened."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumnRenamed("deviation", "deviation_exact").withColumn(
        "deviation", F.expr("try_cast(deviation_exact AS bigint)")
    )
