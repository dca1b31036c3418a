"""Workbooks (.xlsx): a folder of them as a table, and tables packed into workbooks.

One task handles one workbook; the format caps a sheet at 1,048,576 rows, so that is a
bounded piece of work however large the folder is.
"""

from __future__ import annotations

import datetime as dt
import functools
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.sources.delimited import unique_names
from rowsieve.sources.landing import BAD, BLOCK, FILE, POSITION, Landed, finish, number_rows
from rowsieve.session import settle

# --- fixed values -----------------------------------------------------------
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMAT_IDS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
DAY_ZERO = dt.datetime(1899, 12, 30)
DAY_ZERO_1904 = dt.datetime(1904, 1, 1)
# --- end of fixed values ----------------------------------------------------

ROWS_PER_FRAME = 10_000
_ROW, _VALUE, _TEXT = (f"{SHEET_NS}{tag}" for tag in ("row", "v", "t"))
WORKBOOK_ROWS = 100_000
# Tasks that pack a table, at least.
BOOK_TASKS = 64
CELLS = f"{FILE} string, {POSITION} long, header array<string>, cells array<string>"


@functools.lru_cache(20_000)
def _column_of(letters: str) -> int:
    number = 0
    for letter in letters:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _column_number(reference: str) -> int:
    return _column_of(reference.rstrip("0123456789"))


def _all_text(node: ElementTree.Element) -> str:
    return "".join([t.text or "" for t in node.iter(_TEXT)])


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Path of the first sheet and whether day numbers count from 1904."""
    top = ElementTree.fromstring(book.read("xl/workbook.xml"))
    settings = top.find(f"{SHEET_NS}workbookPr")
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    link = top.find(f"{SHEET_NS}sheets/{SHEET_NS}sheet").get(f"{LINK_NS}id")
    for target in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if target.get("Id") == link:
            name = target.get("Target")
            return (name.lstrip("/") if name.startswith("/") else f"xl/{name}"), from_1904
    raise ValueError("workbook has no first sheet")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Style numbers that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    top = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(DATE_FORMAT_IDS)
    for fmt in top.iter(f"{SHEET_NS}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.IGNORECASE):
            dated.add(int(fmt.get("numFmtId")))
    formats = top.find(f"{SHEET_NS}cellXfs")
    uses = [] if formats is None else list(formats)
    return {i for i, use in enumerate(uses) if int(use.get("numFmtId", 0)) in dated}


def _as_day(text: str, from_1904: bool) -> str:
    start = DAY_ZERO_1904 if from_1904 else DAY_ZERO
    moment = start + dt.timedelta(days=float(text))
    return moment.strftime("%Y-%m-%d" if float(text) % 1 == 0 else "%Y-%m-%d %H:%M:%S")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cell texts of the first sheet, row by row; left-out rows come as empty rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, from_1904 = _first_sheet(book)
        dated = _date_styles(book)
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_all_text(item) for item in strings]
        expected = 1
        with book.open(path) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != _ROW:
                    continue
                for _ in range(int(node.get("r", expected)) - expected):
                    yield []
                    expected += 1
                row: list[str | None] = []
                for cell in node:
                    reference = cell.get("r")
                    at = _column_number(reference) if reference else len(row)
                    if at >= len(row):
                        row.extend([None] * (at + 1 - len(row)))
                    kind = cell.get("t")
                    if kind == "inlineStr":
                        row[at] = _all_text(cell)
                        continue
                    value = cell.find(_VALUE)
                    text = None if value is None else value.text
                    if kind == "s" and text is not None:
                        text = shared[int(text)]
                    elif kind == "b" and text is not None:
                        text = "True" if text == "1" else "False"
                    elif kind in (None, "n") and text and int(cell.get("s", 0)) in dated:
                        text = _as_day(text, from_1904)
                    row[at] = text
                yield row
                expected += 1
                node.clear()


def read_cells(workbooks: DataFrame, header_row: int = 0) -> DataFrame:
    """``(path, content)`` rows as one row per sheet row, with the header of its workbook."""

    def frame(path: str, header: list[str], numbers: list[int], held: list[list]) -> pa.RecordBatch:
        n, width = len(held), len(header)
        ends = pa.array(range(0, n * width + 1, width) if width else [0] * (n + 1), pa.int32())
        names = pa.array(header, pa.string())
        cells = pa.array([cell for row in held for cell in row], pa.string())
        repeated = names.take(pa.array(np.tile(np.arange(width), n)))
        return pa.record_batch(
            [pa.array([path] * n, pa.string()), pa.array(numbers, pa.int64()),
             pa.ListArray.from_arrays(ends, repeated), pa.ListArray.from_arrays(ends, cells)],
            [FILE, POSITION, "header", "cells"],
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One workbook at a time leaves the batch.
            for path, content in zip(batch.column(0), batch.column(1)):
                header: list[str] = []
                numbers: list[int] = []
                held: list[list] = []
                for number, row in enumerate(sheet_rows(content.as_py())):
                    if number < header_row:
                        continue
                    if number == header_row:
                        header = unique_names([cell or "" for cell in row])
                        continue
                    row.extend([None] * (len(header) - len(row)))
                    numbers.append(number)
                    held.append(row[: len(header)])
                    if len(held) == ROWS_PER_FRAME:
                        yield frame(path.as_py(), header, numbers, held)
                        numbers, held = [], []
                if held:
                    yield frame(path.as_py(), header, numbers, held)

    return workbooks.select("path", "content").mapInArrow(parse, CELLS)


def ingest_workbooks(workbooks: DataFrame, header_row: int = 0) -> Landed:
    """Rows of all workbooks, columns matched by name, numbered in (path, row) order."""
    cells = settle(
        read_cells(workbooks, header_row).withColumn(BLOCK, F.lit(0).cast("long")), "workbooks"
    )
    found = cells.select("header").distinct().select(F.explode("header").alias("name")).distinct()
    names = sorted(r["name"] for r in found.collect())  # the columns of the table to be
    by_name = F.map_from_arrays("header", "cells")
    table = cells.withColumn("_row", by_name).select(
        FILE, BLOCK, POSITION, *[F.col("_row")[n].alias(n) for n in names]
    )
    rejected = cells.limit(0).select(F.col(FILE).alias("file"), F.lit("").alias("line"))
    numbered, _ = number_rows(table.withColumn(BAD, F.lit(False)))
    return finish(numbered, names, rejected)


def scan_workbook_folder(spark: SparkSession, path: str) -> DataFrame:
    """The .xlsx files of a folder as ``(path, content)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]")
    return files.load(path).select("path", "content")


# --- packing ----------------------------------------------------------------

_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels"'
    ' ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
    'relationships/{kind}" Target="{target}"/></Relationships>'
)
_BOOK = (
    f'<workbook xmlns="{SHEET_NS[1:-1]}" xmlns:r="{LINK_NS[1:-1]}">'
    '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
)


def workbook_bytes(header: list[str], rows: Iterator[tuple]) -> bytes:
    """A workbook with one sheet of text cells; null cells are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr(
            "_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml")
        )
        book.writestr("xl/workbook.xml", _BOOK)
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"),
        )
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{SHEET_NS[1:-1]}"><sheetData>'.encode())
            for number, row in enumerate([tuple(header), *rows], start=1):
                cells = "".join(
                    f'<c r="{_column_name(i)}{number}" t="inlineStr"><is>'
                    f'<t xml:space="preserve">{escape(str(cell))}</t></is></c>'
                    for i, cell in enumerate(row)
                    if cell is not None
                )
                sheet.write(f'<row r="{number}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


@functools.lru_cache(20_000)
def _column_name(number: int) -> str:
    name = ""
    number += 1
    while number:
        number, letter = divmod(number - 1, 26)
        name = chr(65 + letter) + name
    return name


def pack_workbooks(
    df: DataFrame, prefix: str, rows_per_book: int = WORKBOOK_ROWS
) -> DataFrame:
    """A table as workbooks ``(path, content)`` of ``rows_per_book`` consecutive rows each."""
    columns = [c for c in df.columns if c != "row_index"]
    texts = df.select("row_index", *[F.col(c).cast("string") for c in columns])
    book_no = F.floor(F.col("row_index") / rows_per_book).cast("long")
    # Many tasks of a few books each: all cores have work to the end, and little at a time.
    tasks = max(BOOK_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.withColumn("_book_no", book_no).repartition(tasks, "_book_no")

    def pack(key: tuple, books: pa.Table) -> pa.Table:
        ordered = books.sort_by("row_index")
        rows = zip(*[ordered.column(i + 1).to_pylist() for i in range(len(columns))])
        path = f"{prefix}-{key[0].as_py():08d}.xlsx"
        content = workbook_bytes(columns, rows if columns else [()] * len(ordered))
        return pa.table({"path": [path], "content": pa.array([content], pa.binary())})

    return dealt.groupBy("_book_no").applyInArrow(pack, "path string, content binary")
