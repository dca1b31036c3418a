"""Queries that send tables through files and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.config import EXPENSE_COLUMNS, NA_WORDS, RunConfig
from rowsieve.functions.text import na_to_null
from rowsieve.operators import package, validate
from rowsieve.plans import twins
from rowsieve.plans.ledger_queries import LEDGER, SKIPS, sample_skips
from rowsieve.plans.registry import query
from rowsieve.plans.rule_queries import RULES
from rowsieve.session import scratch_path
from rowsieve.sources.delimited import ingest_delimited
from rowsieve.sources.dispatch import ingest_folder, with_route
from rowsieve.sources.sinks import CSV_OPTIONS, write_rows
from rowsieve.sources.workbook import ingest_workbooks, pack_workbooks
from rowsieve.sources.tables import EXPENSE_AS_OF, expenses, table

NA_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in NA_WORDS)
TEXT_COLUMNS = ("employee_id", "dept", "amount", "currency", "spend_date", "vendor", "fx_rate")
CLEANED = "SELECT row_index, " + ", ".join(
    f"CASE WHEN {c} NOT IN ({NA_LIST}) THEN {c} END AS {c}" for c in TEXT_COLUMNS
)


@query("csv_round_trip", twins.with_x() + CLEANED + " FROM x")
def csv_round_trip(spark, sf_dir: str) -> DataFrame:
    """Write the expense table as CSV, read it back: same rows, same order, words as null."""
    path = scratch_path(spark, "csv")
    write_rows(expenses(spark, sf_dir), path, "1", "csv", ordered=True)
    return ingest_delimited(spark, f"{path}/run_id=1").table


@query(
    "csv_documents",
    f"""SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_index,
  CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN lang NOT IN ({NA_LIST}) THEN lang END AS lang, sha256(text) AS text_fp
FROM documents""",
)
def csv_documents(spark, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks, quotes and separators survive the trip."""
    path = scratch_path(spark, "docs")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_index"), "doc_id", "lang", "text"
    )
    write_rows(docs, path, "1", "csv", ordered=True)
    landed = ingest_delimited(spark, f"{path}/run_id=1", multi_line=True).table
    return landed.select("row_index", "doc_id", "lang", F.sha2("text", 256).alias("text_fp"))


@query(
    "na_words",
    twins.with_x()
    + f"""SELECT row_index, CASE WHEN amount NOT IN ({NA_LIST}) THEN amount END AS amount,
  CASE WHEN vendor NOT IN ({NA_LIST}) THEN vendor END AS vendor FROM x""",
)
def na_words(spark, sf_dir: str) -> DataFrame:
    cells = {c: na_to_null(F.col(c)) for c in ("amount", "vendor")}
    return expenses(spark, sf_dir).withColumns(cells).select("row_index", "amount", "vendor")


@query(
    "ingest_summary",
    twins.with_x()
    + """SELECT count(*) AS row_count,
  'employee_id,dept,amount,currency,spend_date,vendor,fx_rate' AS columns FROM x""",
)
def ingest_summary(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_rows(expenses(spark, sf_dir), path, "1", "csv")
    per_file = ingest_delimited(spark, f"{path}/run_id=1").summary
    return per_file.groupBy(F.array_join("columns", ",").alias("columns")).agg(
        F.sum("row_count").alias("row_count")
    )


NULLED = ", ".join(
    f"CASE WHEN {c} IN ({', '.join(repr(w) for w in ('n/a', ''))}) THEN NULL ELSE {c} END AS {c}"
    for c in EXPENSE_COLUMNS
)


def _quoted(c: str):
    """A cell as a CSV file holds it."""
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))


def _write_lines(df: DataFrame, path: str, line, header: str) -> None:
    """Text files in row order, each with its own header lines on its first row."""
    ordered = df.repartitionByRange("row_index").sortWithinPartitions("row_index")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    ordered.select(
        F.when(first, F.concat(F.lit(header), line)).otherwise(line).alias("value")
    ).write.text(path)


@query("header_row", twins.with_x() + f"SELECT row_index, {NULLED} FROM x")
def header_row(spark, sf_dir: str) -> DataFrame:
    """Two title lines above the header are left out in every file."""
    path = scratch_path(spark, "titled")
    title = "Report,of,expenses,by,day,and,desk\nprinted today\n" + ",".join(EXPENSE_COLUMNS) + "\n"
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in EXPENSE_COLUMNS])
    _write_lines(expenses(spark, sf_dir), path, line, title)
    return ingest_delimited(spark, path, header_row=2).table


@query(
    "csv_line_breaks",
    twins.with_x()
    + """SELECT row_index, employee_id, employee_id || chr(10) || '"' || dept || '", ' || currency AS note
FROM x""",
)
def csv_line_breaks(spark, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and commas come back whole with default options."""
    path = scratch_path(spark, "broken")
    x = expenses(spark, sf_dir).withColumn(
        "note", F.concat("employee_id", F.lit('\n"'), "dept", F.lit('", '), "currency")
    )
    _write_lines(x, path, F.concat_ws(",", "employee_id", _quoted("note")), "employee_id,note\n")
    return ingest_delimited(spark, path).table


@query(
    "rejected_lines",
    twins.with_x() + "SELECT employee_id || ',' || dept || ',extra' AS line FROM x WHERE dept = 'SALES'",
)
def rejected_lines(spark, sf_dir: str) -> DataFrame:
    """Lines with a cell too many are set aside; the other rows are read."""
    path = scratch_path(spark, "ragged")
    x = expenses(spark, sf_dir)
    extra = F.when(F.col("dept") == "SALES", F.lit(",extra")).otherwise(F.lit(""))
    plain = F.concat("employee_id", F.lit(","), "dept", extra)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    x.select(
        F.when(first, F.concat(F.lit("employee_id,dept\n"), plain)).otherwise(plain)
    ).write.text(path)
    return ingest_delimited(spark, path).rejected.select("line")


@query(
    "file_routes",
    """SELECT name, CASE WHEN name LIKE '%.csv' THEN 'delimited'
  WHEN name LIKE '%.XLSX' THEN 'workbook' END AS route,
  CASE WHEN name LIKE '%.txt' THEN 'Unsupported file type: txt'
       WHEN name NOT LIKE '%.%' THEN 'Unsupported file type: ' END AS problem
FROM (SELECT 'doc-' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.csv'
        WHEN 'fr' THEN '.XLSX' WHEN 'de' THEN '.txt' ELSE '' END AS name FROM documents)""",
)
def file_routes(spark, sf_dir: str) -> DataFrame:
    suffix = (
        F.when(F.col("lang") == "en", ".csv")
        .when(F.col("lang") == "fr", ".XLSX")
        .when(F.col("lang") == "de", ".txt")
        .otherwise("")
    )
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), suffix)
    files = table(spark, sf_dir, "documents").select(name.alias("name"))
    return with_route(files, "name")


@query(
    "reingest_strip",
    twins.with_x(skips=SKIPS)
    + CLEANED.replace(
        "SELECT row_index", "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index"
    )
    + " FROM x WHERE row_index IN (SELECT row_index FROM skips)",
)
def reingest_strip(spark, sf_dir: str) -> DataFrame:
    """The error set as CSV is valid input again; its added columns are left out."""
    x = expenses(spark, sf_dir)
    ledger = validate.error_ledger(x, RULES)
    config = RunConfig(as_of=EXPENSE_AS_OF)
    errors = package.split_rows(x, sample_skips(x), ledger, config)[1]
    path = scratch_path(spark, "errors")
    write_rows(errors, path, "1", "csv", ordered=True)
    return ingest_delimited(spark, f"{path}/run_id=1").table


@query(
    "reingest_ledger",
    twins.with_x(**LEDGER)
    + """SELECT rule_no, count(*) AS errors FROM ledger GROUP BY rule_no""",
)
def reingest_ledger(spark, sf_dir: str) -> DataFrame:
    """All rules, repeats among them, find the same errors after a trip through files."""
    path = scratch_path(spark, "csv")
    write_rows(expenses(spark, sf_dir), path, "1", "csv", ordered=True)
    landed = ingest_delimited(spark, f"{path}/run_id=1").table
    found = validate.error_ledger(landed, RULES)
    return found.groupBy("rule_no").agg(F.count("*").alias("errors"))


def _mixed_folder(spark, sf_dir: str) -> str:
    """The expense table as CSV files, and other files beside them."""
    path = scratch_path(spark, "mixed")
    x = expenses(spark, sf_dir)
    ordered = x.repartitionByRange("row_index").sortWithinPartitions("row_index").drop("row_index")
    ordered.write.options(**CSV_OPTIONS).csv(path)
    x.select("vendor").distinct().coalesce(1).write.mode("append").text(path)
    return path


@query("folder_ingest", twins.with_x() + CLEANED + " FROM x")
def folder_ingest(spark, sf_dir: str) -> DataFrame:
    """The files of a folder that a reader takes."""
    return ingest_folder(spark, _mixed_folder(spark, sf_dir)).delimited.table


@query(
    "rejected_files",
    "SELECT 'Unsupported file type: txt' AS problem, 1 AS n FROM orders HAVING count(*) > 0",
)
def rejected_files(spark, sf_dir: str) -> DataFrame:
    """Files no reader takes, with the reason."""
    rejected = ingest_folder(spark, _mixed_folder(spark, sf_dir)).rejected
    return rejected.groupBy("problem").agg(F.count("*").cast("int").alias("n"))


@query("workbook_round_trip", twins.with_x() + CLEANED + " FROM x")
def workbook_round_trip(spark, sf_dir: str) -> DataFrame:
    """The expense table packed into workbooks and read back."""
    books = pack_workbooks(expenses(spark, sf_dir), "expenses", rows_per_book=5_000)
    return ingest_workbooks(books).table


@query(
    "workbook_sizes",
    twins.with_x()
    + """SELECT 'expenses-' || lpad(CAST(row_index // 5000 AS VARCHAR), 8, '0') || '.xlsx'
  AS file_name, count(*) AS row_count FROM x GROUP BY 1""",
)
def workbook_sizes(spark, sf_dir: str) -> DataFrame:
    """Rows per workbook, from the ingest summary."""
    books = pack_workbooks(expenses(spark, sf_dir), "expenses", rows_per_book=5_000)
    return ingest_workbooks(books).summary.select("file_name", "row_count")
