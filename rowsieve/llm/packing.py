"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.tokens import encoder, release
from rowsieve.session import settle

CAPACITY = 1024
#: Pieces that share one window when ranks inside a length are given out, about.
RANK_ROWS = 100_000
#: Bytes of text that are encoded and cut at a time, about.
TEXT_BYTES = 1_000_000
#: Chunks that a worker remembers: ids of pieces need the memory that more of them would take.
REMEMBER = 500_000
_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def bounded(
    batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``most_bytes`` of text, a row at least, so that
    what is made of a slice stays small whatever Spark puts in a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        slices = np.cumsum(sizes.astype(np.int64)) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces (doc_id, row, piece, start, length, ids_crc32) of the encoded rows of ``docs``.

    Each row is its ids and ``end_id``. Longer rows than ``capacity`` are cut into full pieces
    behind a first one that takes the remainder. Null texts are empty: the end id alone. ``row``
    tells rows apart that share a doc_id; settle the pieces before they are used twice, as it is
    given out by the scan. ``with_ids`` adds ``ids``, the piece's ids as little-endian unsigned
    32-bit integers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer, REMEMBER), struct.pack("<I", end_id)
        for part in bounded(batches, 2):
            rows: list[tuple] = []
            texts = [t or "" for t in part.column(2).to_pylist()]
            names, numbers = part.column(0).to_pylist(), part.column(1).to_pylist()
            for name, number, ids in zip(names, numbers, tool.encode(texts)):
                ids += end
                n = len(ids) // 4
                at = 0
                size = n if n <= capacity else n % capacity or capacity
                piece = 0
                while at < n:
                    cut_ids = ids[4 * at : 4 * (at + size)]
                    made = (name, number, piece, at, size, zlib.crc32(cut_ids))
                    rows.append((*made, cut_ids) if with_ids else made)
                    at, size, piece = at + size, capacity, piece + 1
            cols = list(zip(*rows)) or [[]] * len(names_out)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names_out)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names_out = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    schema = _PIECES
    if with_ids:
        kinds, names_out = [*kinds, pa.binary()], [*names_out, "ids"]
        schema += ", ids binary"
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )
    return numbered.mapInArrow(cut, schema)


def best_fit_moves(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """Best-fit rounds over lengths in descending order; (moves, number of sequences).

    Documents of one length and gaps of one size are runs: a round takes the next length, sweeps
    the gaps upward from its successor, the smallest that holds it, and fills them run by run;
    the sequences filled become runs of a smaller gap before the next round. A run of documents
    meets a run of gaps by rank. A move says: pieces of ``length`` with ranks from ``rank`` go
    ``each`` to a sequence, from sequence ``first`` on, behind ``filled`` tokens. The state is at
    most ``capacity`` lengths and gap sizes, however many documents there are.
    """
    gaps: dict[int, deque] = {}
    moves: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            runs = gaps.setdefault(gap, deque())
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")

        def fill(gap: int, first: int, n: int) -> None:
            """Puts pieces in a run of ``n`` sequences; what it does not need stays as it was."""
            nonlocal left, rank
            each = gap // length
            full = min(n, left // each)
            if full:
                moves.append((length, rank, each, first, capacity - gap))
                left, rank = left - full * each, rank + full * each
                add(gap - each * length, first, full)
            if left and full < n:
                moves.append((length, rank, left, first + full, capacity - gap))
                add(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                gaps.setdefault(gap, deque()).appendleft((first + full, n - full))

        for gap in range(length, capacity):
            while left and gaps.get(gap):
                fill(gap, *gaps[gap].popleft())
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            first, opened = opened, opened + n
            fill(capacity, first, n)
    return pd.DataFrame(moves, columns=["length", "rank", "each", "first", "filled"]), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to settled pieces (doc_id, row, piece, length, …).

    The driver sees the number of pieces of each length, ``capacity`` numbers at most, and
    plans the rounds on them. Pieces get their rank inside their length in windows of about
    ``rank_rows`` rows: a hot length is dealt to many by a hash, whose counts are summed first.
    Rows with equal ids and pieces are placed each by itself, and dealt by ``row`` as well, so
    that an id on many rows is not one window. An empty table stays empty.
    """
    total = pieces.count()
    salts = max(8, -(-total // rank_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)))
    counts = settle(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    by_length = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    moves, _ = best_fit_moves(by_length, capacity)
    plan = {
        int(length): tuple(part[c].to_numpy() for c in ("rank", "each", "first", "filled"))
        for length, part in moves.groupby("length")
    }

    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        "length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece")
    ranked = (
        salted.withColumn("inside", F.row_number().over(inside))
        .join(starts, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("inside") - 1)
    )
    names = [c for c in ("doc_id", "row", "piece", "start", "length", "ids_crc32", "ids")
             if c in pieces.columns]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        release()  # the chunks that this worker remembers since it encoded
        seq = np.zeros(len(lengths), np.int64)
        off = np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            rank, each, first, filled = plan[int(length)]
            wanted = ranks.to_numpy()[rows]
            at = np.searchsorted(rank, wanted, side="right") - 1
            inside = wanted - rank[at]
            seq[rows] = first[at] + inside // each[at]
            off[rows] = filled[at] + inside % each[at] * length
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    # Python sees two numbers a piece; its ids stay where they are.
    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select(*names, "place.sequence_id", "place.offset")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every row with its sequence and place there; texts are read once."""
    pieces = cut_pieces(docs, tokenizer, end_id, capacity, with_ids)
    return pack(settle(pieces, "pieces"), capacity)


def joined_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences out of pieces packed ``with_ids``, ids as in a piece.

    Pieces carry their ids, so rows may share a doc_id. A group is one sequence, ``capacity`` ids
    at most. An empty table has no sequences.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"])
    )
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def sequence_ids(
    packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for documents with unique doc_id.

    Texts are encoded again and joined to their places, so ids are never held twice on disk.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            names, at, parts = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), tool.encode(texts)):
                flat = np.frombuffer(ids + end, "<u4").astype(np.int32)
                n = len(flat)
                cuts = [0, *range(n if n <= capacity else n % capacity or capacity, n + 1, capacity)]
                for a, b in zip(cuts, cuts[1:]):
                    names.append(name)
                    at.append(a)
                    parts.append(flat[a:b])
            yield pa.record_batch(
                [pa.array(names, pa.int64()), pa.array(at, pa.int64()),
                 pa.array(parts, pa.list_(pa.int32()))],
                ["doc_id", "start", "ids"],
            )

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        pieces, "doc_id long, start long, ids array<int>"
    )
    places = packed.select("doc_id", "start", "sequence_id", "offset")
    both = made.join(places, ["doc_id", "start"])
    return both.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
        ).alias("ids")
    )
