"""Records of delimited text whose quoted cells hold line breaks, read in splits.

A split starts at a line break that may lie inside a quoted cell. Every split reports how it
leaves the quotes for both ways it can be entered, outside or inside a cell; a scan over the
splits of a file, a row each, tells which one it is, and a second pass cuts records.
A record over several splits is put together from the pieces they give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.session import settle
from rowsieve.sources.landing import BLOCK, FILE, POSITION

#: A whole record, the open start of one at the end of a split, what a split has of one before it.
RECORD, START, REST = 0, 1, 2
_CUT = f"{FILE} string, {BLOCK} long, {POSITION} long, piece int, text string"


def text_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Physical lines with their file and split; only a line feed ends one."""
    reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
    )


def ends_inside(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open at the end of a line, if none or if one was open before it.

    A quote opens a cell at its very start only; two quotes inside stand for one.
    """
    inside = '(?:[^"]++|"")*+'
    start = f"(?:^|\\Q{sep}\\E)\""
    closed = lambda text: F.regexp_replace(text, f'{start}{inside}"', "x")
    still = lambda text: closed(text).rlike(start)
    quotes = line.contains('"')
    closing = f'^{inside}"'
    from_inside = ~line.rlike(closing) | still(F.regexp_replace(line, closing, "x"))
    return quotes & still(line), ~quotes | from_inside


def has_line_breaks(spark: SparkSession, path: str, sep: str, pattern: str = "*") -> bool:
    """Whether any cell holds a line break: some line, read by itself, leaves a cell open."""
    lines = text_lines(spark, path, pattern)
    return not lines.filter(ends_inside(F.col("value"), sep)[0]).isEmpty()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of one file and split in a batch."""
    files, blocks = batch.column(0), batch.column(1)
    n = batch.num_rows
    if not n:
        return
    same = pc.and_(pc.equal(files[1:], files[:-1]), pc.equal(blocks[1:], blocks[:-1]))
    cuts = [0, *(i + 1 for i, s in enumerate(same.to_pylist()) if not s), n]
    for a, b in zip(cuts, cuts[1:]):
        yield (files[a].as_py(), blocks[a].as_py()), a, b


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, inside): whether each split starts inside a quoted cell."""
    out, inside = ends_inside(F.col("value"), sep)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How the lines with quotes of each split lead from either state to the next."""
        found: list[tuple] = []
        key, leads = None, (False, True)
        for batch in batches:
            for here, a, b in _runs(batch):
                if here != key:
                    if key is not None:
                        found.append((*key, *leads))
                    key, leads = here, (False, True)
                for steps in zip(batch.column(2)[a:b].to_pylist(), batch.column(3)[a:b].to_pylist()):
                    leads = steps[leads[0]], steps[leads[1]]
        if key is not None:
            found.append((*key, *leads))
        cols = list(zip(*found)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(cols, kinds)], [FILE, BLOCK, "from_out", "from_in"]
        )

    quoted = lines.filter(F.col("value").contains('"')).select(FILE, BLOCK, out.alias("o"), inside.alias("i"))
    leads = quoted.mapInArrow(fold, f"{FILE} string, {BLOCK} long, from_out boolean, from_in boolean")
    blocks = settle(
        lines.select(FILE, BLOCK).distinct().join(leads, [FILE, BLOCK], "left"), "splits"
    )
    # A split that ends the same whichever way it starts fixes the state; since the last such one
    # only the number of splits that turn it matters.
    fixed = F.col("from_out") == F.col("from_in")
    turns = F.coalesce((F.col("from_out") & ~F.col("from_in")).cast("int"), F.lit(0))
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(FILE).orderBy(BLOCK)
    turned = F.coalesce(F.sum(turns).over(before), F.lit(0))
    last = F.last(F.when(fixed, F.struct(F.col("from_out").alias("s"), F.col("turned").alias("t"))), True)
    states = (
        blocks.withColumn("turned", F.sum(turns).over(upto))
        .withColumn("turned_before", turned)
        .withColumn("last", last.over(before))
    )
    odd = (F.col("turned_before") - F.coalesce(F.col("last.t"), F.lit(0))) % 2 == 1
    at_last = F.coalesce(F.col("last.s"), F.lit(False))
    return states.select(FILE, BLOCK, (at_last != odd).alias("inside"))


def cut_records(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, position, piece, text): records and pieces of records of every split.

    Lines are read in place, without a shuffle. Tasks are told which splits start inside a cell:
    one number each, of the splits the driver plans anyway. Blank lines between records go.
    """
    starts: dict[str, set[int]] = {}
    for file, block in split_states(lines, sep).filter("inside").select(FILE, BLOCK).collect():
        starts.setdefault(file, set()).add(block)
    out, inside = ends_inside(F.col("value"), sep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        held: list[str] = []  # lines of the record that is open
        is_rest = False
        rows: list[tuple] = []

        def batch_of(cols: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            names = [FILE, BLOCK, POSITION, "piece", "text"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        def close(piece: int) -> None:
            nonlocal at, held
            text = "\n".join(held)
            if piece == RECORD:
                text = text.removesuffix("\r")
            rows.append((*key, at, piece, text))
            at, held = at + 1, []

        def leave_split() -> None:
            if key is not None and (held or is_rest):
                close(REST if is_rest else START)

        for batch in batches:
            for here, a, b in _runs(batch):
                if here != key:
                    leave_split()
                    key, at, held = here, 0, []
                    is_rest = here[1] in starts.get(here[0], ())
                text, opens = batch.column(2)[a:b], batch.column(3)[a:b]
                if not held and not is_rest and not pc.any(opens).as_py():
                    # Every line is a record.
                    text = pc.replace_substring_regex(text, "\r$", "")
                    text = text.filter(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0))
                    n = len(text)
                    if rows:
                        yield batch_of(list(zip(*rows)))
                        rows = []
                    yield batch_of([[here[0]] * n, [here[1]] * n, range(at, at + n), [RECORD] * n, text])
                    at += n
                    continue
                for line, o, i in zip(text.to_pylist(), opens.to_pylist(), batch.column(4)[a:b].to_pylist()):
                    if held or is_rest:
                        held.append(line)
                        if not i:
                            close(REST if is_rest else RECORD)
                            is_rest = False
                    elif line.strip():
                        held.append(line)
                        if not o:
                            close(RECORD)
            if len(rows) > 10_000:
                yield batch_of(list(zip(*rows)))
                rows = []
        leave_split()
        if rows:
            yield batch_of(list(zip(*rows)))

    told = lines.select(FILE, BLOCK, "value", out.alias("opens"), inside.alias("stays"))
    return told.mapInArrow(cut, _CUT)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(file, block, position, text): records over several splits, at the place of their start."""
    place = Window.partitionBy(FILE).orderBy(BLOCK, POSITION)
    is_start = (F.col("piece") == START).cast("long")
    part = F.struct(BLOCK, POSITION, "text")
    whole = F.sort_array(F.collect_list(part))
    text = F.array_join(F.transform(whole, lambda x: x["text"]), "\n")
    return (
        pieces.withColumn("chain", F.sum(is_start).over(place))
        .groupBy(FILE, "chain")
        .agg(whole[0][BLOCK].alias(BLOCK), whole[0][POSITION].alias(POSITION),
             F.regexp_replace(text, "\r\\z", "").alias("text"))
        .select(FILE, BLOCK, POSITION, "text")
    )


def cells(text: Column, n: int, sep: str, corrupt: str) -> Column:
    """A record's cells c0, c1, … and ``corrupt``, the record itself where their number differs."""
    schema = ", ".join(f"c{i} string" for i in range(n)) + f", {corrupt} string"
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return F.from_csv(text, schema, options)
