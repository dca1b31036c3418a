"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm import jaccard_join, line_dedup, mixing, packing, quality_qda
from rowsieve.llm.common import table, words
from rowsieve.llm.queries import END_ID
from rowsieve.llm.tokens import public_path
from rowsieve.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    scored = quality_qda.scored(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select("kept_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out; a document that consisted of nothing else goes."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.filter((F.col("n_removed") == 0) | (F.size(words(F.col("text"))) > 0))
    made = {"n_chars": F.length("text").cast("long")}
    return left.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard_join.keep_one(docs, jaccard_join.jaccard_links(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source as often as its target asks; a document can stay more than once."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents; one row for each piece, with its ids.

    A document that the mixture took more than once is a row each time; ``row`` tells them apart,
    and ``packing.joined_sequences`` makes the sequences from the pieces alone.
    """
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), END_ID, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixture),
    ("best-fit packing", sequences),
]

#: The classifier, the tokenizer and seeded choices are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
