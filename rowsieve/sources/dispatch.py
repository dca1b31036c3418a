"""Which reader a file goes to, by its suffix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.config import ACCEPTED_SUFFIXES
from rowsieve.functions.text import render
from rowsieve.sources.delimited import ingest_delimited
from rowsieve.sources.landing import Landed
from rowsieve.sources.workbook import ingest_workbooks, scan_workbook_folder

# --- fixed values -----------------------------------------------------------
UNSUPPORTED_TEXT = "Unsupported file type: {suffix}"
LEGACY_TEXT = "Failed to parse file: binary .xls workbooks are not readable here"
# --- end of fixed values ----------------------------------------------------


def with_route(files: DataFrame, name: str = "path") -> DataFrame:
    """Add ``route`` (``delimited`` or ``workbook``, else null) and ``problem`` to file names."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))
    return files.withColumns(
        {
            "route": F.when(suffix == "csv", "delimited").when(suffix == "xlsx", "workbook"),
            "problem": F.when(
                ~suffix.isin(*ACCEPTED_SUFFIXES), render(UNSUPPORTED_TEXT, suffix=suffix)
            ).when(suffix == "xls", F.lit(LEGACY_TEXT)),
        }
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the files in a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path")


@dataclass(frozen=True)
class FolderIngest:
    """What each reader found in a folder (None where it had no file), and the other files."""

    delimited: Landed | None
    workbooks: Landed | None
    rejected: DataFrame


def ingest_folder(
    spark: SparkSession, folder: str, header_row: int = 0, sep: str = ","
) -> FolderIngest:
    """Send every file of a folder to its reader."""
    present = with_route(list_files(spark, folder)).select("route").distinct().collect()
    routes = {r["route"] for r in present}
    delimited = workbooks = None
    if "delimited" in routes:
        delimited = ingest_delimited(spark, folder, header_row, sep, pattern="*.[cC][sS][vV]")
    if "workbook" in routes:
        workbooks = ingest_workbooks(scan_workbook_folder(spark, folder), header_row)
    return FolderIngest(delimited, workbooks, rejected_files(spark, folder))


def rejected_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files no reader takes, with the reason."""
    routed = with_route(list_files(spark, folder))
    return routed.filter(F.col("problem").isNotNull()).select("path", "problem")
