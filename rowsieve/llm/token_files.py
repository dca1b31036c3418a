"""Token id files: one id array a shard with Elias-Fano coded document bounds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.llm.tokens import encoder
from rowsieve.session import settle

MAGIC = b"RSTF0001"
#: Ids in one shard file, about; a single longer document makes a longer shard.
SHARD_IDS = 1 << 21
#: One bits between two stored select positions.
STEP = 256


class EliasFano:
    """A non-decreasing list of numbers from 0 up, in about 2 + log2(largest / count) bits each.

    The low bits lie packed side by side; the high bits are unary in a bit string, where the
    i-th one at position p says high(i) = p - i. Every ``STEP``-th one's position is kept, so
    ``get`` scans a bounded stretch.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes, marks: np.ndarray):
        self.n, self.width, self.low, self.high, self.marks = n, width, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must not decrease, nor be below 0")
        width = max(0, int(values[-1] // n).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(width)) & 1
        return cls(
            n,
            width,
            np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(bits, bitorder="little").tobytes(),
            ones[::STEP].astype(np.uint32),
        )

    def get(self, i: int) -> int:
        """The i-th number, by select on the high bits and one read of the low ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.marks[i // STEP]), i % STEP
        if rest:
            byte, seen = at // 8, -(bin(self.high[at // 8] & ((1 << at % 8) - 1)).count("1"))
            while True:
                here = bin(self.high[byte]).count("1")
                if seen + here > rest:
                    break
                seen += here
                byte += 1
            value = self.high[byte]
            for _ in range(rest - seen):
                value &= value - 1
            at = byte * 8 + (value & -value).bit_length() - 1
        first = i * self.width
        piece = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "little")
        low = (piece >> first % 8) & ((1 << self.width) - 1)
        return ((at - i) << self.width) | low

    def all(self) -> np.ndarray:
        """All numbers in order."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        low = np.zeros(self.n, np.int64)
        if self.width:
            flat = np.unpackbits(
                np.frombuffer(self.low, np.uint8), count=self.n * self.width, bitorder="little"
            )
            low = flat.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width))
        return (high << self.width) | low

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.width, len(self.low), len(self.high))
        return head + self.low + self.high + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, width, n_low, n_high = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        n_marks = -(-n // STEP)
        marks = np.frombuffer(data, "<u4", n_marks, at)
        return cls(n, width, low, high, marks), at + 4 * n_marks


def write_shard(doc_ids: list, ids: list[bytes]) -> bytes:
    """The bytes of one shard file: documents in order, ids little-endian and unsigned.

    Head: magic, bytes an id takes (2 or 4), number of documents without an id of their own,
    smallest id. Then Elias-Fano lists of the document ids (less the smallest) and of the
    bounds of the documents in the id array, then the array.
    """
    named = np.array([d for d in doc_ids if d is not None], np.int64)
    nameless = len(doc_ids) - len(named)
    lengths = np.array([len(i) // 4 for i in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    wide = 4 if len(flat) and int(flat.max()) > 0xFFFF else 2
    least = int(named[0]) if len(named) else 0
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return b"".join(
        [
            MAGIC,
            struct.pack("<BQqQ", wide, nameless, least, len(flat)),
            EliasFano.encode(named - least).to_bytes(),
            EliasFano.encode(bounds).to_bytes(),
            flat.astype(f"<u{wide}").tobytes(),
        ]
    )


def read_shard(data: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """(document ids, bounds, id array) of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token id file")
    wide, nameless, least, n_ids = struct.unpack_from("<BQqQ", data, 8)
    named, at = EliasFano.from_bytes(data, 8 + struct.calcsize("<BQqQ"))
    bounds, at = EliasFano.from_bytes(data, at)
    flat = np.frombuffer(data, f"<u{wide}", n_ids, at)
    return [None] * nameless + (named.all() + least).tolist(), bounds, flat


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Encodes texts in ascending doc_id order and writes shard files; returns their table.

    Rows (part, seq, n_ids, content): ``content`` holds the bytes of one file, part and seq its
    place in the order. The files lie in a table so that they go through Spark's committer: a
    task that runs twice leaves one copy, on any store. Rows are range-partitioned by doc_id
    and encoded where they land. Null texts are empty, null ids come first, rows with equal
    ids lie in order of their text; extra columns are not read. Ids must be unique to be looked
    up by id, not to be written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(tokenizer), struct.pack("<I", end_id)
        part, seq = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([size], pa.int64()),
                    pa.array([write_shard(names, held)], pa.binary()),
                ],
                ["part", "seq", "n_ids", "content"],
            )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for name, ids in zip(batch.column(0).to_pylist(), tool.encode(texts)):
                names.append(name)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield shard()
                    names, held, size, seq = [], [], 0, seq + 1
        if names:
            yield shard()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = ordered.mapInArrow(write, "part int, seq int, n_ids long, content binary")
    return settle(rows, "token-files", path)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Each shard is decoded by itself; the ids before it come from sums of the shards' sizes:
    first of whole parts, then inside a part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*(c.to_pylist() for c in batch.columns)):
                names, bounds, flat = read_shard(content)
                at = bounds.all()
                wide = flat.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = len(names)
                yield pa.record_batch(
                    [
                        pa.array([part] * n, pa.int32()),
                        pa.array([seq] * n, pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(at[:-1]),
                        pa.array(np.diff(at)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "content").mapInArrow(
        read, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    parts = parts.select(
        F.col("part"), F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start")
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select(
            "part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start")
        )
        .join(parts, "part")
        .select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base"))
    )
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
