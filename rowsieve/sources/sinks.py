"""Writing the clean and the error set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowsieve.sources.workbook import pack_workbooks

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    # Keep blanks at the ends of a cell.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_rows(
    df: DataFrame, path: str, run_id: str, file_format: str = "parquet", ordered: bool = False
) -> int:
    """Write one run's rows below ``path/run_id=…`` and return how many there were.

    The count rides along with the write. ``ordered`` puts rows in index order across files
    (a range shuffle); the index itself is not written to CSV, which has no place for it.
    ``workbook`` writes a Parquet table of packed workbooks ``(path, content)``.
    """
    if ordered and file_format != "workbook":
        df = df.repartitionByRange("row_index").sortWithinPartitions("row_index")
    seen = Observation()
    observed = df.observe(seen, F.count("*").alias("n"))
    if file_format == "csv":
        observed = observed.drop("row_index")
    elif file_format == "workbook":
        observed = pack_workbooks(observed, f"{path.rstrip('/').rsplit('/', 1)[-1]}-{run_id}")
    container = "parquet" if file_format == "workbook" else file_format
    writer = observed.write.mode("overwrite").format(container)
    if file_format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.save(f"{path.rstrip('/')}/run_id={run_id}")
    return seen.get["n"]


def write_results(
    success: DataFrame,
    errors: DataFrame,
    path: str,
    run_id: str,
    file_format: str = "parquet",
) -> dict[str, int]:
    """Write both sets; other runs below ``path`` stay as they are."""
    return {
        "valid_count": write_rows(success, f"{path}/success", run_id, file_format),
        "error_count": write_rows(errors, f"{path}/errors", run_id, file_format, ordered=True),
    }
