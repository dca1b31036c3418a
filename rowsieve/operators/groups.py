"""Grouped look-back and lookups that survive one key holding a third of all rows.

Look-back: a table none of whose keys is too big for a task is a plain window. Any other is
range-partitioned by key and order, so a key of any size is cut by rank; each piece hands its last
value to the next, inside a task and from task to task.
Lookups: keys too big for a task are salted. A one-pass sketch finds such keys; it decides how
work is spread, never which rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsieve.session import settle

# Rows one task orders; more are cut into pieces of about this many.
PIECE_ROWS = 1_000_000
# Smaller pieces than that are handed to at most so many tasks (or the shuffle partitions, if more).
MOST_TASKS = 100
# Keys tracked by the sketch; a key above roughly 1/2000 of all rows cannot be missed.
TRACKED_KEYS = 10_000
# Largest table that is sent whole to every executor, by rows and by bytes of its cells as text.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
MAX_SALT = 1_000


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys worth splitting, as plan constants."""

    hashes: tuple[int, ...]
    largest: int

    def __bool__(self) -> bool:
        return bool(self.hashes)

    def test(self, keys: Sequence[str]) -> Column:
        return F.xxhash64(*keys).isin(*self.hashes)


def hot_keys(df: DataFrame, keys: Sequence[str], piece_rows: int = PIECE_ROWS) -> HotKeys:
    """Keys with more than ``piece_rows`` rows: one scan of the key columns, no shuffle of rows."""
    sketch = F.call_function(
        "approx_top_k", F.xxhash64(*keys), F.lit(TRACKED_KEYS), F.lit(TRACKED_KEYS)
    )
    found = df.agg(sketch.alias("top")).select(
        F.filter("top", lambda t: t["count"] > piece_rows).alias("top")
    )
    top = found.first()["top"] or []
    return HotKeys(
        tuple(sorted(t["item"] for t in top)), max((t["count"] for t in top), default=0)
    )


def value_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    skip_nulls: bool = False,
    piece_rows: int = PIECE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``name``: the value of the closest earlier row (by ``order``) with the same keys.

    Rows of equal order come in any order, but one. With ``skip_nulls`` the closest earlier
    non-null value is taken. Null keys form a group of their own. As long as no key has more than
    ``piece_rows`` rows this is a window, one shuffle by key; else see :func:`ranged_pieces`.
    ``rows`` is their number, counted if not given.
    """
    rows = df.count() if rows is None else rows
    if rows <= piece_rows:
        window = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn(name, _look_back(value, window, skip_nulls))
    if not hot_keys(df, keys, piece_rows):
        shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        width = -(-rows // PIECE_ROWS)
        dealt = df.repartition(width, *keys) if width > shuffled else df
        window = Window.partitionBy(*keys).orderBy(order, _tie(df))
        return dealt.withColumn(name, _look_back(value, window, skip_nulls))
    pieces = settle(ranged_pieces(df, keys, order, value, name, skip_nulls, rows, piece_rows), "pieces")

    # One row a task: its first and last key, and the value it hands on.
    boxed = F.struct(F.col("_value").alias("v"))
    place = F.struct("_key", order, "_tie")
    handed = F.when(F.col("_value").isNotNull(), place) if skip_nulls else place
    ends = pieces.groupBy("_piece").agg(
        F.min("_key").alias("_first_key"),
        F.max_by(F.struct(F.col("_key").alias("k"), boxed.alias("b")), handed).alias("_tail"),
    )
    # Keys rise from task to task, so a tail with another key than the first one here is over.
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.last("_tail", ignorenulls=True).over(before)
    carry = ends.withColumn("_tail", tail).filter("_tail.k = _first_key")
    carry = carry.select("_piece", F.col("_first_key").alias("_carry_key"), F.col("_tail.b").alias("_carry"))
    joined = pieces.join(F.broadcast(carry), "_piece", "left")  # a row a task
    opens = F.col("_open") & (F.col("_key") == F.col("_carry_key"))
    found = F.when(opens, F.col("_carry.v")).otherwise(F.col(name))
    return joined.withColumn(name, found).select(*df.columns, name)


def ranged_pieces(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    skip_nulls: bool,
    rows: int,
    piece_rows: int,
) -> DataFrame:
    """``df`` sorted by key and order over tasks that go through pieces of at most ``piece_rows``
    rows, with ``name`` as far as a task knows it.

    Spark samples the ranges, so a task's share is cut by rank: sparse, dense and equal order
    values give shares of one size, as rows of equal order are told apart by a hash of their cells
    (only rows alike in everything stay together). There is a task a piece, as long as these are
    few; small pieces share a task, which hands the value on from each to the next as they stream
    by, so tasks follow the rows and never the number of pieces. Adds ``_piece``, the task's
    number, the key as text ``_key``, ``_tie``, ``_value`` and ``_open``: the rows whose value may
    lie in an earlier task.
    """
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(MOST_TASKS, -(-rows // PIECE_ROWS))
    width = max(min(-(-rows // piece_rows), most), shuffled)
    made = df.withColumns(
        {
            "_key": F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])),
            "_tie": _tie(df),
            "_value": value,
        }
    )
    by = ["_key", order, "_tie"]
    ranged = made.repartitionByRange(width, *by).sortWithinPartitions(*by)
    schema = T.StructType(
        [*ranged.schema, T.StructField(name, ranged.schema["_value"].dataType),
         T.StructField("_open", T.BooleanType()), T.StructField("_piece", T.IntegerType())]
    )
    at_key, at_value = ranged.columns.index("_key"), ranged.columns.index("_value")

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        first_key = last_key = None  # of the piece, and of the row before
        carry = None  # the value that row hands on, as an array of one; None if there is none
        open_run = True  # still in the piece's first key, and nothing handed on yet
        for batch in batches:
            found, is_open = [], []
            for at in range(0, batch.num_rows, piece_rows):
                part = batch.slice(at, piece_rows)
                n = part.num_rows
                key, values = part.column(at_key), part.column(at_value)
                first_key = key[0].as_py() if first_key is None else first_key
                starts = np.ones(n, bool)
                starts[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
                starts[0] = key[0].as_py() != last_key
                if starts[0]:
                    carry = None
                # Place of the row whose value is handed on: 0 the carried one, i + 1 row i.
                given = pc.is_valid(values).to_numpy(zero_copy_only=False) if skip_nulls else np.ones(n, bool)
                run = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
                latest = np.maximum.accumulate(np.where(given, np.arange(1, n + 1), 0))
                before = np.concatenate([[0], latest[:-1]])
                carried = (run == 0) & (before == 0) & (not starts[0]) & (carry is not None)
                known = before > run
                from_row = np.where(known, before, 0)
                pool = pa.concat_arrays([carry if carry is not None else values[:1], values])
                found.append(pool.take(pa.array(from_row, mask=~(known | carried))))
                in_first = np.zeros(n, bool)
                if open_run:
                    in_first = pc.equal(key, first_key).to_numpy(zero_copy_only=False)
                    open_run = bool(in_first[-1])
                is_open.append(~(known | carried) & in_first)
                # What the last row's key has handed on by now.
                if latest[-1] > run[-1]:
                    carry = values[latest[-1] - 1 : latest[-1]]
                elif run[-1] > 0 or starts[0]:
                    carry = None
                last_key = key[n - 1].as_py()
            if found:
                pieces = pa.array(np.full(batch.num_rows, piece, np.int32))
                cols = [*batch.columns, pa.concat_arrays(found), pa.array(np.concatenate(is_open)), pieces]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return ranged.mapInArrow(look_back, schema)


def _tie(df: DataFrame) -> Column:
    """Tells rows of equal order apart."""
    return F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])


def _look_back(value: Column, window, skip_nulls: bool) -> Column:
    if not skip_nulls:
        return F.lag(value).over(window)
    return F.last(value, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, -1)
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows (counted) of ``most_bytes`` together (measured)."""
    size = F.lit(0).cast("long")
    for name in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)) + 8
    counted, held = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return counted <= rows and held <= most_bytes


def if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` marked for broadcast when it :func:`is_small`, else as it is."""
    return F.broadcast(df) if is_small(df, rows, most_bytes) else df


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Left join on ``key`` with a ``right`` side that has one row per key.

    A right side of at most ``broadcast_rows`` rows, and bounded bytes, is broadcast (both are
    checked). A larger one is shuffled, and keys that are hot on the left are salted over
    ``spread_by``.
    """
    if is_small(right, broadcast_rows):
        return left.join(F.broadcast(right), key, "left")
    hot = hot_keys(left, [key], piece_rows)
    if not hot:
        return left.join(right, key, "left")
    salts = min(MAX_SALT, hot.largest // piece_rows + 1)
    is_hot = hot.test([key])
    salted_left = left.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(0)
    )
    salted_right = right.withColumn(
        "_salt",
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    joined = salted_left.join(salted_right, [key, "_salt"], "left")
    return joined.select(key, *[c for c in joined.columns if c not in (key, "_salt")])
