"""Delimited text as tables of text columns.

Nothing is inferred: a cell keeps the characters it has in the file, except that the
usual "no value" words become null.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.session import settle
from rowsieve.sources import quoted
from rowsieve.sources.landing import (
    BAD,
    BLOCK,
    FILE,
    POSITION,
    Landed,
    check_headers,
    finish,
    number_rows,
    stage,
)

CORRUPT = "_corrupt_record"
LINE = "_line"


def unique_names(header: list[str]) -> list[str]:
    """Column names for a header line: unnamed and repeated names get a number."""
    names: list[str] = []
    for i, cell in enumerate(header):
        name = base = cell if cell != "" else f"Unnamed: {i}"
        repeat = 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def read_header(
    spark: SparkSession, path: str, header_row: int, sep: str, pattern: str = "*"
) -> list[str]:
    """The header of the first file, taken from its first ``header_row + 1`` non-empty lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(path)
    lines = (
        spark.read.text(first).filter(F.trim("value") != "").limit(header_row + 1).collect()
    )
    if len(lines) <= header_row:
        raise ValueError(f"{first} has no line {header_row}")
    return next(csv.reader([lines[header_row]["value"]], delimiter=sep))


def scan_delimited(
    spark: SparkSession,
    path: str,
    header_row: int = 0,
    sep: str = ",",
    multi_line: bool = False,
    pattern: str = "*",
) -> DataFrame:
    """Lazy scan: all columns text, plus where each row came from.

    With ``header_row`` 0 the header lines are left out by the reader. Otherwise they are
    still among the rows; :func:`rowsieve.sources.landing.number_rows` leaves them out.
    """
    header = read_header(spark, path, header_row, sep, pattern)
    names = unique_names(header)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header_row == 0)
        # A file whose header differs fails loudly instead of shifting its cells.
        .option("enforceSchema", header_row != 0 or names != header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("pathGlobFilter", pattern)
    )
    return reader.csv(path).select(
        *names, CORRUPT, F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
    )


def too_long(names: list[str], sep: str) -> Column:
    """True for a line with more cells than the header; a shorter line is padded with nulls."""
    unquoted = F.regexp_replace(CORRUPT, '"([^"]|"")*"', "")
    cells = F.size(F.split(unquoted, f"\\Q{sep}\\E", -1))
    # Always true of an over-long line. It keeps all columns in the scan: the reader only
    # notices extra cells when it parses every column.
    has_rest = F.length(CORRUPT) > F.length(F.concat_ws("", *names))
    return F.coalesce((cells > len(names)) & has_rest, F.lit(False))


def _staged_lines(scan: DataFrame, names: list[str], sep: str) -> DataFrame:
    """The scan written once; lines with too many cells are marked and kept as they are."""
    bad = too_long(names, sep)
    line = F.when(bad, F.col(CORRUPT)).alias(LINE)
    return stage(scan.select(*[f"`{c}`" for c in names], FILE, BLOCK, bad.alias(BAD), line), "rows")


def _staged_records(
    spark: SparkSession, path: str, names: list[str], sep: str, pattern: str
) -> DataFrame:
    """Records with line breaks in cells, cut in splits; header lines are among them."""
    lines = quoted.text_lines(spark, path, pattern)
    cell = {f"c{i}": name for i, name in enumerate(names)}

    def parsed(records: DataFrame, *more: str) -> DataFrame:
        read = records.withColumn("_cells", quoted.cells(F.col("text"), len(names), sep, CORRUPT))
        read = read.select(
            FILE, BLOCK, POSITION, *more, F.col(f"_cells.{CORRUPT}"),
            *[F.col(f"_cells.{c}").alias(name) for c, name in cell.items()],
        )
        bad = too_long(names, sep)
        return read.withColumns({BAD: bad, LINE: F.when(bad, F.col(CORRUPT))}).drop(CORRUPT)

    piece = F.when(F.col("piece") != quoted.RECORD, F.col("text")).alias("text")
    cut = settle(
        parsed(quoted.cut_records(lines, sep).withColumn("piece_text", piece), "piece", "piece_text"),
        "records",
    )
    pieces = cut.filter(F.col("piece") != quoted.RECORD)
    joined = quoted.joined_pieces(
        pieces.select(FILE, BLOCK, POSITION, "piece", F.col("piece_text").alias("text"))
    )
    whole = cut.filter(F.col("piece") == quoted.RECORD).drop("piece", "piece_text")
    return whole.unionByName(settle(parsed(joined), "joined-records"))


def ingest_delimited(
    spark: SparkSession,
    path: str,
    header_row: int = 0,
    sep: str = ",",
    multi_line: bool | None = None,
    pattern: str = "*",
) -> Landed:
    """Read files, set over-long lines aside, number the rows and write them once.

    Large files are read in splits. Whether any quoted cell holds a line break is looked up
    first, by one scan of the lines; then Spark's reader takes the lines, or records are cut
    from the splits (:mod:`rowsieve.sources.quoted`). ``multi_line`` True or False settles that
    beforehand.
    """
    header = read_header(spark, path, header_row, sep, pattern)
    names = unique_names(header)
    if multi_line is None:
        multi_line = quoted.has_line_breaks(spark, path, sep, pattern)
    if multi_line:
        staged, header_lines = _staged_records(spark, path, names, sep, pattern), header_row + 1
    else:
        scan = scan_delimited(spark, path, header_row, sep, False, pattern)
        staged, header_lines = _staged_lines(scan, names, sep), header_row + 1 if header_row else 0
    if header_lines and names == header:
        check_headers(staged, header_lines, header, names)
    table, rejected = number_rows(staged, header_lines)
    return finish(
        table.drop(LINE), names, rejected.select(F.col(FILE).alias("file"), F.col(LINE).alias("line"))
    )
