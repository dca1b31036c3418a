"""Ranked lexical search: best-first document intervals over range-maximum tables."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.session import settle

#: Bytes of item text answered in one pass over the documents; a single longer item is one pass.
BLOCK_BYTES = 8 << 20
#: Postings indexed at once in a task.
SHARD_POSTINGS = 1_000_000
#: Intervals of at most this many documents are scored document by document.
LEAF_DOCS = 128
#: Groups that a rank over all tasks goes through first.
MERGE_SALTS = 256
_NO_ID = 1 << 63  # orders a null id behind all others

#: ASCII letters in lower case and digits stay, other ASCII becomes a blank, the rest is kept.
_TERM_BYTES = bytes(
    c if c > 0x7F or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower()
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; none for null."""
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of some documents side by side, with one sparse table of range maxima.

    Postings are ordered by term, then document; ``keys`` is term * documents + document. Entry
    i of level j of the table is the place of the largest impact among the 2^j postings from i;
    ranges asked for lie inside one term's list, so entries that reach into the next list are
    never read.
    """

    def __init__(self, ids: list, slots: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        self.ids, self.n = ids, len(ids)
        keys = slots.astype(np.int64) * self.n + docs
        order = np.argsort(keys, kind="stable")
        self.keys, self.docs, self.impacts = keys[order], docs[order], impacts[order]
        longest = int(np.unique(slots, return_counts=True)[1].max()) if len(slots) else 0
        self.levels = [np.arange(len(keys), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            last = self.levels[-1]
            left, right = last[:-step], last[step:]
            self.levels.append(
                np.where(self.impacts[left] >= self.impacts[right], left, right)
            )
            step *= 2

    def lists(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place of each term's list."""
        return (
            np.searchsorted(self.keys, slots * self.n),
            np.searchsorted(self.keys, (slots + 1) * self.n),
        )

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each non-empty range of places."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for j in range(int(level.max()) + 1 if len(level) else 0):
            at = np.flatnonzero(level == j)
            if len(at):
                left = self.levels[j][low[at]]
                right = self.levels[j][high[at] - (1 << j)]
                out[at] = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return out

    def search(
        self, slots: np.ndarray, repeats: np.ndarray, heap: list, k: int, leaf: int = LEAF_DOCS
    ) -> None:
        """Brings ``heap`` of (score, -id) up to date with the k best documents of this shard.

        The open interval with the highest bound goes first; its bound is the sum, over the
        item's terms, of the largest impact inside. It is split at the document that holds the
        largest of these, which is scored; both sides get bounds of their own. An interval
        that cannot reach the worst of a full heap is dropped, and the search ends when none can.
        """
        low, high = self.lists(slots)
        queue: list[tuple] = []
        made = 0

        def open_interval(a: int, b: int, slots, repeats, low, high) -> None:
            nonlocal made
            some = high > low
            if a >= b or not some.any():
                return
            if not some.all():
                slots, repeats, low, high = slots[some], repeats[some], low[some], high[some]
            top = self.maxima(low, high)
            parts = self.impacts[top] * repeats
            bound = int(parts.sum())
            if bound > 0 and not (len(heap) == k and (bound, -self.ids[a]) <= heap[0]):
                made += 1
                split = int(self.docs[top[parts.argmax()]])
                heapq.heappush(queue, (-bound, made, a, b, split, slots, repeats, low, high))

        def offer(score: int, doc: int) -> None:
            entry = (score, -self.ids[doc])
            if score > 0:
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

        open_interval(0, self.n, slots, repeats, low, high)
        while queue:
            minus, _, a, b, split, slots, repeats, low, high = heapq.heappop(queue)
            if len(heap) == k:
                if -minus < heap[0][0]:
                    return
                if (-minus, -self.ids[a]) <= heap[0]:
                    continue
            if b - a <= leaf:
                size = high - low
                at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                scores = np.zeros(b - a, np.int64)
                np.add.at(scores, self.docs[at] - a, self.impacts[at] * np.repeat(repeats, size))
                floor = heap[0][0] if len(heap) == k else 1
                for doc in np.flatnonzero(scores >= floor).tolist():
                    offer(int(scores[doc]), a + doc)
                continue
            place = np.searchsorted(self.keys, slots * self.n + split)
            held = np.zeros(len(slots), np.int64)
            inside = place < high
            held[inside] = self.docs[place[inside]] == split
            offer(int((self.impacts[np.minimum(place, high - 1)] * repeats * held).sum()), split)
            open_interval(a, split, slots, repeats, low, place)
            open_interval(split + 1, b, slots, repeats, place + held, high)


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, slots, tfs): the number of terms of every document, and the vocabulary's
    slots it holds with their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.get
        for batch in batches:
            slots: list[int] = []
            tfs: list[int] = []
            sizes, ends = [], [0]
            for text in batch.column(1).to_pylist():
                found = terms(text)
                sizes.append(len(found))
                held = Counter(map(look, found))
                held.pop(None, None)
                slots.extend(held.keys())
                tfs.extend(held.values())
                ends.append(len(slots))
            at = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(slots, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "slots", "tfs"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return rows.mapInArrow(count, "doc_id long, n long, slots array<int>, tfs array<int>")


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """Items with their ``block``, and the blocks; one's texts hold ``block_bytes`` or are one item.

    Blocks are dealt by a hash; their number doubles until the largest holds.
    """
    sized = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    key = F.xxhash64("item_id", "text")
    size = F.octet_length("text") + 64
    total, rows = sized.agg(F.sum(size), F.count(F.lit(1))).first()
    blocks = max(1, min(-(-int(total or 0) // block_bytes), 4 * rows))
    while 1 < blocks < 4 * rows:
        per = sized.groupBy(F.pmod(key, F.lit(blocks)).alias("b")).agg(
            F.sum(size).alias("s"), F.countDistinct("item_id", "text").alias("n")
        )
        if not per.filter((F.col("s") > block_bytes) & (F.col("n") > 1)).head(1):
            break
        blocks *= 2
    dealt = sized.withColumn("block", F.pmod(key, F.lit(blocks)))
    return dealt, [r[0] for r in dealt.select("block").distinct().collect()]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    block_bytes: int = BLOCK_BYTES,
    shard_postings: int = SHARD_POSTINGS,
    leaf: int = LEAF_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, all considered.

    Every row of ``items`` is an item and every row of ``docs`` a document, also where ids are
    null or repeat; null ids come last among equal scores. Items are answered in blocks of a
    bounded size, whose terms go to all tasks: one pass over the texts writes the counts of
    those terms, a second over the counts indexes and searches the documents of each task in
    shards. Only k rows an item and task are shuffled. An item without a term, an item no
    document scores for, and an empty table give no rows. Extra columns are not read.
    """
    dealt, blocks = item_blocks(items, block_bytes)
    found = None
    for block in blocks or [0]:
        # At most block_bytes of text, or the rows of one item.
        asked = dealt.filter(F.col("block") == block).select("item_id", "text").collect()
        part = _search_block(docs, [(r[0], r[1]) for r in asked], k, shard_postings, leaf)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(
    docs: DataFrame, asked: list[tuple], k: int, shard_postings: int, leaf: int
) -> DataFrame:
    names = [name for name, _ in asked]
    vocabulary: dict[bytes, int] = {}
    wanted = []
    for _, text in asked:
        held = Counter(terms(text))
        slots = [vocabulary.setdefault(t, len(vocabulary)) for t in held]
        wanted.append((np.array(slots, np.int64), np.array(list(held.values()), np.int64)))
    counts = settle(forward_index(docs, vocabulary), "term-counts")
    total = counts.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    ).first()
    n_docs, n_terms = int(total["docs"]), int(total["n"])
    dfs = counts.select(F.explode("slots").alias("slot")).groupBy("slot").count()
    weights = np.zeros(len(vocabulary), np.int64)
    for slot, df in dfs.collect():  # a row for each term of the block
        weights[slot] = weight(n_docs, df)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        heaps: list[list] = [[] for _ in wanted]
        ids: list = []
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            shard = _shard(ids, held, weights)
            for (slots, repeats), heap in zip(wanted, heaps):
                if len(slots):
                    shard.search(slots, repeats, heap, k, leaf)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                slots, tfs = rows.column(2), rows.column(3)
                sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
                flat = slots.flatten().to_numpy()
                ids += [_NO_ID if i is None else i for i in rows.column(0).to_pylist()]
                lengths = [
                    25 + 75 * n * n_docs // n_terms if n else 25 for n in rows.column(1).to_pylist()
                ]
                held.append((sizes, flat, tfs.flatten().to_numpy(), lengths))
                size += len(flat)
                if size >= shard_postings:
                    flush()
                    ids, held, size = [], [], 0
        if ids:
            flush()
        out = [(task, i, *entry) for i, heap in enumerate(heaps) for entry in heap]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.record_batch(
            [
                pa.array(cols[0], pa.int64()),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array([None if x == -_NO_ID else -x for x in cols[3]], pa.int64()),
            ],
            ["task", "item", "score", "doc_id"],
        )

    hits = counts.mapInArrow(answer, "task long, item long, score long, doc_id long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    by_salt = Window.partitionBy("item", "salt").orderBy(*order)
    best = (
        hits.withColumn("salt", F.pmod("task", F.lit(MERGE_SALTS)))
        .withColumn("rank", F.row_number().over(by_salt))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
        .filter(F.col("rank") <= k)
    )
    known = docs.sparkSession.createDataFrame(
        list(enumerate(names)), "item long, item_id long"
    )
    return best.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")


def _shard(ids: list, held: list[tuple], weights: np.ndarray) -> Shard:
    order = sorted(range(len(ids)), key=ids.__getitem__)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sizes = np.concatenate([h[0] for h in held])
    slots = np.concatenate([h[1] for h in held])
    tfs = np.concatenate([h[2] for h in held]).astype(np.int64)
    lengths = np.array([m for h in held for m in h[3]], np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    impacts = weights[slots] * (1_000_000_000 * tfs // (1000 * tfs + 8 * lengths[row]))
    some = impacts > 0
    return Shard([ids[i] for i in order], slots[some], place[row[some]], impacts[some])


ORACLE = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (SELECT row_no, doc_id, coalesce(len(terms), 0) AS n, terms FROM doc_terms),
totals AS (SELECT count(*) FILTER (n > 0) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tf AS (
  SELECT row_no, term, count(*) AS tf
  FROM (SELECT row_no, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY term),
items AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY ALL),
scored AS (
  SELECT item_id, row_no, doc_id, sum(
    repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))
  )::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (row_no), totals
  GROUP BY item_id, row_no, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
