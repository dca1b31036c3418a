"""Numbering rows in file order and landing them.

Rows are written once together with (file, block, running number in the task); the dense
index is that number plus an offset per block. Offsets are one row per file block, so no
global sort and no single-task window over the rows is needed. Header lines and lines set aside
are among the rows written and marked; only blocks with lines set aside are numbered anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.config import OUTPUT_COLUMNS
from rowsieve.functions.text import na_to_null
from rowsieve.session import settle

FILE = "_file"
BLOCK = "_block"
POSITION = "_position"
BAD = "_bad"


class EmptyTableError(ValueError):
    """Raised when an ingest found no rows."""


@dataclass(frozen=True)
class Landed:
    """An ingested table with ``row_index``, its per-file summary and the lines set aside."""

    table: DataFrame
    summary: DataFrame
    rejected: DataFrame


def stage(scan: DataFrame, name: str) -> DataFrame:
    """Write a scan with a running number per task, which is fixed from then on."""
    return settle(scan.withColumn(POSITION, F.monotonically_increasing_id()), name)


def _offsets(blocks: DataFrame) -> DataFrame:
    """Rows before each block, from (file, block, _n, …), a row each."""
    in_file = Window.partitionBy(FILE).orderBy(BLOCK)
    # Files are added up in stretches by their folder, then inside a folder, so the one task
    # that orders everything sees one row a folder.
    folder = F.regexp_extract(FILE, "^(.*/)[^/]*$", 1)
    files = blocks.groupBy(FILE).agg(F.sum("_n").alias("_file_n")).withColumn("_folder", folder)
    in_folder = Window.partitionBy("_folder").orderBy(FILE)
    folders = files.groupBy("_folder").agg(F.sum("_file_n").alias("_folder_n")).withColumn(
        "_folder_start",
        F.sum("_folder_n").over(Window.orderBy("_folder")) - F.col("_folder_n"),
    )
    starts = (
        files.withColumn("_in_folder", F.sum("_file_n").over(in_folder) - F.col("_file_n"))
        .join(folders, "_folder")
        .select(FILE, (F.col("_folder_start") + F.col("_in_folder")).alias("_file_start"))
    )
    return (
        blocks.withColumn("_in_file", F.sum("_n").over(in_file) - F.col("_n"))
        .join(starts, FILE)
        .withColumn("_overall", F.col("_file_start") + F.col("_in_file"))
        .drop("_in_file", "_file_start")
    )


class HeaderError(ValueError):
    """Raised when a file's header differs from the first one's."""


def check_headers(staged: DataFrame, header_lines: int, header: list[str], names: list[str]) -> None:
    """Every file's header must equal the first file's: their cells would be shifted otherwise.

    Only the first block of each file is read.
    """
    first = staged.filter(F.col(BLOCK) == 0)
    start = first.groupBy(FILE).agg(F.min(POSITION).alias("_first"))
    differs = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"`{c}`"), F.lit("")) != F.lit(h) for c, h in zip(names, header)],
    )
    line = F.col(POSITION) - F.col("_first") == header_lines - 1
    wrong = first.join(start, FILE).filter(line & (differs | F.col(BAD))).head(1)
    if wrong:
        found = [wrong[0][c] or "" for c in names]
        raise HeaderError(f"{wrong[0][FILE]} has the columns {found}, not {header}")


def number_rows(staged: DataFrame, header_lines: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with ``row_index`` 0..n-1 in (file, position) order, lines set aside).

    The first ``header_lines`` rows of every file are neither; a block is written by one task
    from its start, so they are its first block's first positions.
    """
    place = staged.groupBy(FILE, BLOCK).agg(
        F.count("*").alias("_all"), F.min(POSITION).alias("_first"), F.count_if(BAD).alias("_bad_n")
    )
    head = F.when(F.col(BLOCK) == 0, F.least(F.lit(header_lines), F.col("_all"))).otherwise(F.lit(0))
    place = place.withColumn("_head", head.cast("long"))
    after = F.col(POSITION) - F.col("_first") >= F.col("_head")
    if header_lines:
        # A title line can have too many cells; it is no line set aside.
        place = settle(place, "places")
        titles = staged.filter(F.col(BAD) & (F.col(BLOCK) == 0)).join(place, [FILE, BLOCK])
        titles = titles.filter(~after).groupBy(FILE, BLOCK).agg(F.count("*").alias("_bad_titles"))
        place = place.join(titles, [FILE, BLOCK], "left").withColumn(
            "_bad_n", F.col("_bad_n") - F.coalesce("_bad_titles", F.lit(0))
        )
    counts = place.withColumn("_n", F.col("_all") - F.col("_head") - F.col("_bad_n"))
    # A written table: Spark knows its bytes and broadcasts it while it is small.
    offsets = settle(_offsets(counts.drop("_bad_titles")), "offsets")
    placed = staged.join(offsets, [FILE, BLOCK]).filter(after)
    made = [c for c in offsets.columns if c not in (FILE, BLOCK)]
    index = F.col("_overall") + F.col(POSITION) - F.col("_first") - F.col("_head")
    numbered = placed.withColumn("row_index", index)
    if offsets.filter("_bad_n > 0").isEmpty():
        kept = numbered
    else:
        in_block = Window.partitionBy(FILE, BLOCK).orderBy(POSITION)
        anew = placed.filter(F.col("_bad_n") > 0).filter(~F.col(BAD))
        anew = anew.withColumn("row_index", F.col("_overall") + F.row_number().over(in_block) - 1)
        kept = numbered.filter(F.col("_bad_n") == 0).unionByName(anew)
    return (
        kept.drop(*made, BLOCK, POSITION, BAD),
        placed.filter(BAD).drop(*made, BLOCK, POSITION, BAD),
    )


def normalise(df: DataFrame, names: list[str]) -> DataFrame:
    """Leave out columns an earlier run added; read "no value" words as null."""
    kept = [c for c in names if c not in OUTPUT_COLUMNS]
    others = [c for c in df.columns if c not in names]
    return df.select(*others, *[na_to_null(F.col(c)).alias(c) for c in kept])


def finish(numbered: DataFrame, names: list[str], rejected: DataFrame) -> Landed:
    table = normalise(numbered, names)
    return Landed(table.drop(FILE), ingest_summary(table), rejected)


def ingest_summary(table: DataFrame) -> DataFrame:
    """Rows and columns per file."""
    columns = [c for c in table.columns if c not in (FILE, "row_index")]
    return table.groupBy(FILE).agg(F.count("*").alias("row_count")).select(
        F.element_at(F.split(FILE, "/"), -1).alias("file_name"),
        "row_count",
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
    )


def confirm_rows(table: DataFrame) -> str:
    """The status after an ingest; a table without rows is an error."""
    if table.isEmpty():
        raise EmptyTableError("no rows were ingested")
    return "RUNNING"
