import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from rowsieve.operators import package, validate
from rowsieve.session import settle
from rowsieve.sources import dispatch, landing, quoted, sinks
from rowsieve.sources.delimited import ingest_delimited, unique_names
from rowsieve.sources.workbook import (
    ingest_workbooks,
    pack_workbooks,
    scan_workbook_folder,
    sheet_rows,
    workbook_bytes,
)
from tests.helpers import CONFIG, RULES, collect, distinct_rows, row, table

HEADER = "employee_id,dept,amount,currency,spend_date,vendor,fx_rate"
MIXED = f"""{HEADER}
KL90,OPS,88.10,GBP,2023-11-30,Harbour Lamps,1.21
PW4410,FIN,40213.75,INR,2024-05-02,Quarry Tools,83.4
x1,Design,0,CHF,2024/05/02,,9000
TT52,ENG,12.00,USD,2024-03-18,North Pier,1
"""


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_mixed_file(spark, tmp_path):
    landed = ingest_delimited(spark, put(tmp_path / "in", "mixed.csv", MIXED))
    assert landed.table.columns == ["row_index", *HEADER.split(",")]
    # Text stays as written.
    assert collect(landed.table, "row_index", "amount") == [
        (0, "88.10"), (1, "40213.75"), (2, "0"), (3, "12.00"),
    ]
    found = validate.error_ledger(landed.table, RULES)
    assert collect(found, "row_index", "rule_no") == [(2, i) for i in (1, 2, 3, 4, 5, 6)]
    assert collect(landed.summary, "file_name", "row_count") == [("mixed.csv", 4)]
    assert landed.rejected.isEmpty()
    assert landing.confirm_rows(landed.table) == "RUNNING"


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for i in (2, 0, 1):
        lines = "".join(f"r{i}-{j:03d}\n" for j in range(50))
        put(tmp_path / "many", f"part-{i}.csv", "name\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    try:
        landed = ingest_delimited(spark, str(tmp_path / "many"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [f"r{i}-{j:03d}" for i in range(3) for j in range(50)]
    got = [r["name"] for r in landed.table.orderBy("row_index").collect()]
    assert got == expected
    assert [r[0] for r in landed.table.select("row_index").orderBy("row_index").collect()] == list(
        range(150)
    )


def test_no_value_words_and_leading_zeros(spark, tmp_path):
    text = 'a,b\n0012,NA\nnan, NA\n"x, ""y""",null\n-,  \n'
    landed = ingest_delimited(spark, put(tmp_path / "na", "f.csv", text))
    assert collect(landed.table) == [
        (0, "0012", None), (1, None, " NA"), (2, 'x, "y"', None), (3, "-", "  "),
    ]


def test_ragged_lines(spark, tmp_path):
    text = 'a,b\n1,2\n3\n4,5,6\n"x,y",7\n"x,y",7,8\n'
    landed = ingest_delimited(spark, put(tmp_path / "ragged", "f.csv", text))
    assert collect(landed.table) == [(0, "1", "2"), (1, "3", None), (2, "x,y", "7")]
    assert collect(landed.rejected, "line") == [('"x,y",7,8',), ("4,5,6",)]


def test_header_row(spark, tmp_path):
    text = "My report,,\n\nprinted,today\na,b\n1,2\n3,4\n"
    folder = tmp_path / "titled"
    put(folder, "f.csv", text)
    put(folder, "g.csv", text.replace("1,2", "5,6"))
    landed = ingest_delimited(spark, str(folder), header_row=2)
    assert collect(landed.table) == [(0, "1", "2"), (1, "3", "4"), (2, "5", "6"), (3, "3", "4")]


def test_other_separator_and_line_breaks_in_cells(spark, tmp_path):
    text = 'a;b\n"two\nlines";1\nx;2\n'
    path = put(tmp_path / "semi", "f.csv", text)
    landed = ingest_delimited(spark, path, sep=";", multi_line=True)
    assert collect(landed.table) == [(0, "two\nlines", "1"), (1, "x", "2")]


def random_csv(rng, rows):
    """Cells with line breaks, separators, quotes inside and in the middle of open cells."""
    drawn = ["x", 'mid"dle', "two words", "n,o", 'say ""yes""', "a\nb", '\n\n', '",\n"', "1,\n2\n3", "é\r\nü", "tail\r"]
    records, lines = [], []
    for i in range(rows):
        cells, parts = [f"r{i}"], [f"r{i}"]
        for _ in range(2):
            cell = rng.choice(drawn).replace('""', '"')
            plain = cell in ("x", 'mid"dle', "two words")
            cells.append(cell)
            parts.append(cell if plain else '"' + cell.replace('"', '""') + '"')
        records.append(cells)
        lines.append(",".join(parts) + rng.choice(["", "", "\r"]))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "  "]))
    return records, "id,a,b\n" + "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split, seed", [(90, 1), (400, 3)])
def test_cells_with_line_breaks_in_small_splits(spark, tmp_path, split, seed):
    rng = random.Random(seed)
    folder, want = tmp_path / "split", []
    folder.mkdir()
    for name in ("f.csv", "g.csv"):
        records, text = random_csv(rng, 25)
        (folder / name).write_bytes(text.encode())
        want += records
    (folder / "h.csv").write_text('id,a,b\nlong,"' + "a line\n" * 60 + '",z\nlast,"open')
    want += [["long", "a line\n" * 60, "z"], ["last", "open", None]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        landed = ingest_delimited(spark, str(folder))
        got = [tuple(r) for r in landed.table.orderBy("row_index").collect()]
        assert quoted.has_line_breaks(spark, str(folder), ",")
        lines = quoted.text_lines(spark, str(folder))
        most = lines.groupBy(F.spark_partition_id()).agg(F.sum(F.length("value") + 1).alias("n"))
        # No task reads a whole file: a split and the rest of its last line.
        assert most.agg(F.max("n")).first()[0] <= split + 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, *cells) for i, cells in enumerate(want)]
    assert landed.rejected.isEmpty()


def test_splits_of_quotes_are_chained(spark):
    # Split functions of every kind: none, fixed outside, fixed inside, turning.
    made = [("f", 0, 'x,"open'), ("f", 9, "inside all of it"), ("f", 30, 'end",y'), ("f", 40, 'z,"a'),
            ("f", 50, 'b","c'), ("f", 60, '"'), ("f", 70, "plain"), ("g", 0, "plain"), ("g", 9, 'a,"b"')]
    lines = spark.createDataFrame([(v, f, b) for f, b, v in made], f"value string, {landing.FILE} string, {landing.BLOCK} long")
    got = {(r[0], r[1]): r[2] for r in quoted.split_states(lines.coalesce(1), ",").collect()}
    assert [k for k, inside in sorted(got.items()) if inside] == [("f", 9), ("f", 30), ("f", 50), ("f", 60)]


def test_titles_and_long_lines_with_line_breaks(spark, tmp_path):
    text = 'My report,,,,\nprinted,today\na,b\n"1\n2",x\n1,2,3\n3,4\n5,6,"7\n8"\n9,0\n'
    folder = put(tmp_path / "titled", "f.csv", text)
    landed = ingest_delimited(spark, folder, header_row=2)
    assert collect(landed.table) == [(0, "1\n2", "x"), (1, "3", "4"), (2, "9", "0")]
    assert collect(landed.rejected, "line") == [("1,2,3",), ('5,6,"7\n8"',)]
    plain = put(tmp_path / "plain", "f.csv", text.replace('"1\n2"', "1").replace('"7\n8"', "7"))
    landed = ingest_delimited(spark, plain, header_row=2)
    assert collect(landed.table) == [(0, "1", "x"), (1, "3", "4"), (2, "9", "0")]
    assert collect(landed.rejected, "line") == [("1,2,3",), ("5,6,7",)]
    put(tmp_path / "plain", "g.csv", "t\nu\nb,a\n1,2\n")
    with pytest.raises(landing.HeaderError, match="g.csv"):
        ingest_delimited(spark, plain, header_row=2)


def test_unique_names():
    assert unique_names(["a", "", "a", "a", "b"]) == ["a", "Unnamed: 1", "a.1", "a.2", "b"]


def test_files_with_another_header_fail(spark, tmp_path):
    put(tmp_path / "two", "f.csv", "a,b\n1,2\n")
    put(tmp_path / "two", "g.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="CSV header"):
        ingest_delimited(spark, str(tmp_path / "two"))


def test_output_columns_are_stripped(spark, tmp_path):
    text = "a,error_reason,amount_usd,cost_center,approval_required\n1,x,2,3,NO\n"
    landed = ingest_delimited(spark, put(tmp_path / "again", "f.csv", text))
    assert landed.table.columns == ["row_index", "a"]


def test_empty_file(spark, tmp_path):
    landed = ingest_delimited(spark, put(tmp_path / "empty", "f.csv", "a,b\n"))
    with pytest.raises(landing.EmptyTableError):
        landing.confirm_rows(landed.table)


def test_error_set_is_valid_input_again(spark, tmp_path):
    df = table(spark, distinct_rows(3) + [row(employee_id="EMP9", dept="x", vendor=' "q", ')])
    ledger = validate.error_ledger(df, RULES)
    skipped = spark.createDataFrame([(3,)], "row_index bigint")
    success, errors = package.split_rows(df, skipped, ledger, CONFIG)
    counts = sinks.write_results(success, errors, str(tmp_path / "out"), "r1", "csv")
    assert counts == {"valid_count": 3, "error_count": 1}
    again = ingest_delimited(spark, str(tmp_path / "out" / "errors" / "run_id=r1")).table
    assert again.columns == df.columns
    assert collect(again.drop("row_index")) == collect(df.filter("row_index = 3").drop("row_index"))
    # Once more through the whole loop: nothing else changes.
    second = validate.error_ledger(again, RULES)
    assert collect(second, "rule_no", "error_message") == collect(ledger, "rule_no", "error_message")


def test_runs_are_kept_side_by_side(spark, tmp_path):
    df = table(spark, distinct_rows(2))
    none = df.limit(0)
    for run in ("r1", "r2", "r1"):
        sinks.write_results(df, none, str(tmp_path / "runs"), run)
    back = spark.read.parquet(str(tmp_path / "runs" / "success"))
    assert collect(back.groupBy("run_id").count()) == [("r1", 2), ("r2", 2)]


def test_routes(spark, tmp_path):
    for name in ("a.csv", "b.XLSX", "c.txt", "d.xls", "noext", "e.f.json"):
        put(tmp_path / "mix", name, "x")
    routed = dispatch.with_route(dispatch.list_files(spark, str(tmp_path / "mix")))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    assert collect(routed.select(name, "route", "problem")) == [
        ("a.csv", "delimited", None),
        ("b.XLSX", "workbook", None),
        ("c.txt", None, "Unsupported file type: txt"),
        ("d.xls", None, "Failed to parse file: binary .xls workbooks are not readable here"),
        ("e.f.json", None, "Unsupported file type: json"),
        ("noext", None, "Unsupported file type: "),
    ]
    assert dispatch.rejected_files(spark, str(tmp_path / "mix")).count() == 4


def test_mixed_folder(spark, tmp_path):
    folder = tmp_path / "drop"
    put(folder, "a.csv", "x,y\n1,2\n")
    put(folder, "b.CSV", "x,y\n3,4\n")
    put(folder, "notes.txt", "hello")
    (folder / "c.xlsx").write_bytes(workbook_bytes(["x"], iter([("5",)])))
    found = dispatch.ingest_folder(spark, str(folder))
    assert collect(found.delimited.table) == [(0, "1", "2"), (1, "3", "4")]
    assert collect(found.workbooks.table) == [(0, "5")]
    assert collect(found.rejected, "problem") == [("Unsupported file type: txt",)]
    put(tmp_path / "none", "notes.txt", "hello")
    nothing = dispatch.ingest_folder(spark, str(tmp_path / "none"))
    assert nothing.delimited is None and nothing.workbooks is None


def test_results_as_workbooks(spark, tmp_path):
    df = table(spark, distinct_rows(3) + [row(employee_id="EMP9", dept="x")])
    ledger = validate.error_ledger(df, RULES)
    skipped = spark.createDataFrame([(3,)], "row_index bigint")
    success, errors = package.split_rows(df, skipped, ledger, CONFIG)
    counts = sinks.write_results(success, errors, str(tmp_path / "out"), "r1", "workbook")
    assert counts == {"valid_count": 3, "error_count": 1}
    books = spark.read.parquet(str(tmp_path / "out" / "errors" / "run_id=r1"))
    assert collect(books, "path") == [("errors-r1-00000000.xlsx",)]
    content = bytes(books.first()["content"])
    header, cells = list(sheet_rows(content))
    assert header[-1] == "error_reason" and cells[0] == "EMP9"
    assert collect(ingest_workbooks(books).table, "employee_id", "dept") == [("EMP9", "x")]


# --- workbooks --------------------------------------------------------------


def hand_made_workbook(rows_xml, shared="", styles=""):
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(io.BytesIO(workbook_bytes(["a"], iter([])))) as base:
        with zipfile.ZipFile(out, "w") as book:
            for name in base.namelist():
                if "sheet1" not in name:
                    book.writestr(name, base.read(name))
            book.writestr(
                "xl/worksheets/sheet1.xml",
                f'<worksheet xmlns="{main}"><sheetData>{rows_xml}</sheetData></worksheet>',
            )
            if shared:
                book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')
            if styles:
                book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
    return out.getvalue()


def test_cell_kinds():
    content = hand_made_workbook(
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row>'
        '<row r="3"><c r="A3"><v>1500</v></c><c r="B3" s="1"><v>45306</v></c>'
        '<c r="C3" s="2"><v>45306.5</v></c><c r="D3" t="b"><v>1</v></c>'
        '<c r="AA3" t="str"><v>x</v></c></row>',
        shared="<si><r><t>na</t></r><r><t>me</t></r></si>",
        styles='<numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy hh:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs>',
    )
    first, gap, third = list(sheet_rows(content))
    assert first == ["name", None, "c"]
    assert gap == []
    assert third[:4] == ["1500", "2024-01-15", "2024-01-15 12:00:00", "True"]
    assert third[26] == "x" and third[4:26] == [None] * 22


def test_folder_of_workbooks(spark, tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(workbook_bytes(["x", "y"], iter([("1", "NA"), ("2", None)])))
    (folder / "b.XLSX").write_bytes(
        workbook_bytes(["y", "z", "error_reason"], iter([("<3>", "4", "old")]))
    )
    (folder / "c.csv").write_text("x\n1\n")
    landed = ingest_workbooks(scan_workbook_folder(spark, str(folder)))
    assert landed.table.columns == ["row_index", "x", "y", "z"]
    assert collect(landed.table) == [
        (0, "1", None, None), (1, "2", None, None), (2, None, "<3>", "4"),
    ]
    assert collect(landed.summary, "file_name", "row_count") == [("a.xlsx", 2), ("b.XLSX", 1)]


def test_workbook_header_row(spark):
    content = workbook_bytes(["title"], iter([("a", "b"), ("1", "2")]))
    books = spark.createDataFrame([("t.xlsx", bytearray(content))], "path string, content binary")
    assert collect(ingest_workbooks(books, header_row=1).table) == [(0, "1", "2")]


def test_packed_workbooks_round_trip(spark):
    df = table(spark, [row(employee_id=f"E{i:03d}", vendor=None if i % 3 else 'a & "b" <c>') for i in range(25)])
    books = settle(pack_workbooks(df, "out", rows_per_book=10), "books")
    assert collect(books, "path") == [(f"out-{i:08d}.xlsx",) for i in range(3)]
    back = ingest_workbooks(books).table.select(*df.columns)
    assert collect(back) == collect(df)


def test_books_are_packed_by_many_small_tasks(spark):
    # One task packed and read all books of a small exchange, so a batch held them all.
    rows = spark.range(4_000).select(
        (3_999 - F.col("id")).alias("row_index"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("a<"), "id")).alias("name"),
        F.lit(None).cast("string").alias("none"),
    )
    books = pack_workbooks(rows, "b", rows_per_book=100).cache()
    per_task = books.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert books.count() == 40 and per_task <= 8
    landed = ingest_workbooks(books).table
    assert landed.columns == ["row_index", "name", "none"] and landed.count() == 4_000
    want = F.when((3_999 - F.col("row_index")) % 3 > 0, F.concat(F.lit("a<"), (3_999 - F.col("row_index")).cast("string")))
    assert landed.filter(~F.col("name").eqNullSafe(want) | F.col("none").isNotNull()).count() == 0
