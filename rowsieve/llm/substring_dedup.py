"""Substring dedup: windows of words that repeat in a later document, by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import words
from rowsieve.llm.jaccard_join import _mix, _slices
from rowsieve.session import settle

#: Words in a window, and in the n-grams whose smallest hash is a window's minimiser.
WINDOW = 50
GRAM = 16
#: Runs of one minimiser that may share a bucket; above, windows travel one by one.
HOT_RUNS = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


@np.errstate(over="ignore")
def super_kmers(
    word_hashes: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, minimiser) of each run of windows that share a minimiser.

    ``word_hashes`` are those of all texts in a row, ``at`` the bounds of the texts. A run is cut
    where the minimiser changes or the text ends.
    """
    flat = word_hashes.astype(np.int64).view(np.uint64)
    n = len(flat) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    grams = np.zeros(len(flat) - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * _STEP + flat[i : len(flat) - gram + 1 + i]
    grams = _mix(grams)
    least = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(least, grams[i : i + n], out=least)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[:n] == text[window - 1 :]
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (text[1:n] != text[: n - 1])
    starts = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    sizes = np.bincount(run[inside], minlength=len(starts)) if len(starts) else none
    owner = text[starts]
    return owner, starts - at[owner], sizes.astype(np.int64), least[starts].view(np.int64)


@np.errstate(over="ignore")
def first_documents(
    strings: list[bytes], docs: np.ndarray, window: int = WINDOW
) -> list[np.ndarray]:
    """For each string the smallest document of each of its windows, over all the strings.

    Windows are sorted by a rolling hash of their words' numbers; neighbours with equal hashes
    are compared word by word, and sorted by their words if any differ.
    """
    numbers: dict[bytes, int] = {}
    parts = [
        np.fromiter((numbers.setdefault(w, len(numbers)) for w in s.split()), np.int64)
        for s in strings
    ]
    flat = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = np.concatenate(
        [np.arange(e - n, e - window + 1) for e, n in zip(ends.tolist(), sizes.tolist())]
    )
    counts = np.maximum(0, sizes - window + 1)
    coded = _mix((flat.astype(np.uint64) + np.uint64(1)) * _STEP)
    rolled = np.zeros(max(0, len(flat) - window + 1), np.uint64)
    for i in range(window):
        rolled = rolled * _STEP + coded[i : len(flat) - window + 1 + i]
    keys = rolled[starts]
    order = np.argsort(keys, kind="stable")
    a, b = starts[order[:-1]], starts[order[1:]]
    same = keys[order[1:]] == keys[order[:-1]]
    equal = same.copy()
    for i in range(window):
        equal &= flat[a + i] == flat[b + i]
    if not (equal == same).all():
        matrix = flat[starts[:, None] + np.arange(window)]
        _, keys = np.unique(matrix, axis=0, return_inverse=True)
        order = np.argsort(keys.ravel(), kind="stable")
        keys = keys.ravel()
        equal = keys[order[1:]] == keys[order[:-1]]
    owner = np.repeat(np.asarray(docs, np.int64), counts)
    bounds = np.flatnonzero(np.concatenate([[True], ~equal]))
    least = np.minimum.reduceat(owner[order], bounds)
    out = np.zeros(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(bounds, len(order))))
    return np.split(out, np.cumsum(counts)[:-1])


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, row_hash, start, windows, minimiser): the super-k-mers, without their words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, at in _slices(batch):
                text, start, sizes, least = super_kmers(flat, at, window, gram)
                rows = pa.array(text + a)
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(start), pa.array(sizes), pa.array(least)],
                    ["doc_id", "row_hash", "start", "windows", "minimiser"],
                )

    hashed = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", "row_hash", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")
    )
    return hashed.mapInArrow(
        read, "doc_id long, row_hash long, start long, windows long, minimiser long"
    )


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a shared minimiser are done; the others keep their text for what follows."""
    for batch in batches:
        texts, runs = batch.column(2).to_pylist(), batch.column(3)
        counts, sums, kept = [], [], []
        for text, has in zip(texts, runs.is_valid().to_pylist()):
            parts = (text or "").encode("utf-8").split()
            counts.append(len(parts))
            sums.append(None if has else hashlib.sha256(b" ".join(parts)).hexdigest())
            kept.append(text if has else None)
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(kept, pa.string()), runs,
             pa.array(counts, pa.int64()), pa.array(sums, pa.string())],
            ["doc_id", "row_hash", "text", "runs", "n_words", "kept_sha256"],
        )


def _packed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers as strings; of equal ones in a batch one row carries the string."""
    names = ["minimiser", "hot", "digest", "string", "low_doc", "doc_id", "row_hash", "start"]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows: list[list] = []
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(names)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for doc, row, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
            parts = text.encode("utf-8").split()
            for run in runs:
                start = run["start"]
                string = b" ".join(parts[start : start + run["windows"] + window - 1])
                digest = _digest(string)
                made = [run["minimiser"], run["hot"], digest, None, None, doc, row, start]
                if digest in seen:
                    seen[digest][4] = min(seen[digest][4], doc)
                else:
                    made[3], made[4] = string, doc
                    seen[digest] = made
                rows.append(made)
            if len(rows) > 50_000:
                yield flush()
                rows, seen = [], {}
        yield flush()


def _single(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of super-k-mers one by one, as digests."""
    for batch in batches:
        digests, at, windows, lows = [], [], [], []
        for digest, string, low in zip(*(c.to_pylist() for c in batch.columns)):
            parts = string.split()
            for i in range(len(parts) - window + 1):
                digests.append(digest)
                at.append(i)
                windows.append(_digest(b" ".join(parts[i : i + window])))
                lows.append(low)
        yield pa.record_batch(
            [pa.array(digests, pa.binary()), pa.array(at, pa.int32()),
             pa.array(windows, pa.binary()), pa.array(lows, pa.int64())],
            ["digest", "at", "window", "low"],
        )


def _hot_firsts(packed: DataFrame, window: int) -> DataFrame:
    """(digest, firsts) of the super-k-mers of hot minimisers.

    Equal strings are combined first, then each window is a grouped minimum over its digest. Only
    windows that an earlier document has in another string are joined back.
    """
    whole = settle(
        packed.filter(F.col("hot") & F.col("string").isNotNull())
        .groupBy("digest")
        .agg(F.min("low_doc").alias("low"), F.min("string").alias("string")),
        "hot-strings",
    )
    single = settle(
        whole.select("digest", "string", "low").mapInArrow(
            lambda batches: _single(batches, window),
            "digest binary, at int, window binary, low long",
        ),
        "hot-windows",
    )
    first = single.groupBy(F.col("window").alias("its_window")).agg(F.min("low").alias("first"))
    earlier = (
        single.join(first, (F.col("window") == F.col("its_window")) & (F.col("first") < F.col("low")))
        .groupBy("digest")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "first"))).alias("earlier"))
    )
    sizes = single.groupBy("digest").agg(F.first("low").alias("low"), F.count(F.lit(1)).alias("n"))
    places = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    return sizes.join(earlier, "digest", "left").select(
        "digest",
        F.transform(
            places, lambda j: F.coalesce(F.try_element_at("earlier", j), F.col("low"))
        ).alias("firsts"),
    )


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sorted by minimiser: whole buckets at a time, the last of a batch waits for the next."""
    held: dict[bytes, tuple[bytes, int]] = {}
    last = None

    def done(part: dict[bytes, tuple[bytes, int]]) -> pa.RecordBatch:
        found = first_documents(
            [s for s, _ in part.values()], np.array([d for _, d in part.values()]), window
        )
        return pa.record_batch(
            [pa.array(list(part), pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            ["digest", "firsts"],
        )

    ready: dict[bytes, tuple[bytes, int]] = {}
    for batch in batches:
        for key, digest, string, doc in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                ready |= held
                held, last = {}, key
                if len(ready) > 5_000:
                    yield done(ready)
                    ready = {}
            if digest not in held or doc < held[digest][1]:
                held[digest] = (string, doc)
    ready |= held
    if ready:
        yield done(ready)


def _close(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Takes covered words out of the texts."""
    for batch in batches:
        removed, sums, spans = [], [], []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts = text.encode("utf-8").split()
            gone = np.zeros(len(parts) + 1, np.int64)
            at = np.unique(np.array(starts or [], np.int64))
            gone[at] += 1
            np.subtract.at(gone, at + window, 1)
            covered = np.cumsum(gone)[:-1] > 0
            removed.append(int(covered.sum()))
            kept = [p for p, c in zip(parts, covered.tolist()) if not c]
            sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
            spans.append([{"from": int(a), "to": int(b)} for a, b in edges.reshape(-1, 2)])
        yield pa.record_batch(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(sums, pa.string()),
             pa.array(spans, _SPANS), batch.column(3)],
            ["doc_id", "n_removed", "kept_sha256", "removed", "n_words"],
        )


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_runs: int = HOT_RUNS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller
    doc_id. ``removed`` lists the spans of words taken out, from (counted from 0) up to below to.

    1. Each text is cut into super-k-mers, runs of windows with the same minimiser, of which only
       (minimiser, place) is kept. Minimisers seen in one document only are dropped: no window
       of theirs repeats. What is left goes back to its documents, and the rest are done.
    2. The remaining super-k-mers travel as one packed string each to the bucket of their
       minimiser, equal ones of a batch as one. A bucket sorts its windows and finds the smallest
       document of each, exactly.
    3. Of minimisers with more than ``hot_runs`` runs equal strings are combined first, and each
       window goes by itself as a 128-bit digest, whose smallest document is a grouped minimum,
       combined before the shuffle: no bucket holds more than ``hot_runs`` strings.
    4. Firsts join their super-k-mers by digest, and starts of removed windows their documents.

    Joins on minimisers and digests are plain inner joins that adaptive execution splits. Null
    texts have no words; rows with a null doc_id keep all and count for none; rows with equal id
    and text get equal results; different texts under one id do not remove each other's words.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row_hash"),
        "text",
    )
    runs = settle(_runs(named, window, gram), "runs")
    shared = (
        runs.groupBy("minimiser")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high")
        .select("minimiser", (F.col("n") > hot_runs).alias("hot"))
    )
    of_doc = (
        runs.join(shared, "minimiser")
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set(F.struct("start", "windows", "minimiser", "hot")).alias("runs"))
        .select(F.col("doc_id").alias("its_id"), F.col("row_hash").alias("its_hash"), "runs")
    )
    joined = named.join(
        of_doc,
        (F.col("row_hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("its_id")),
        "left",
    ).select("doc_id", "row_hash", "text", "runs")
    run_type = "array<struct<start:bigint,windows:bigint,minimiser:bigint,hot:boolean>>"
    opened = settle(
        joined.mapInArrow(
            _open,
            f"doc_id long, row_hash long, text string, runs {run_type}, n_words long, kept_sha256 string",
        ),
        "opened",
    )
    waiting = opened.filter(F.col("runs").isNotNull())
    packed = settle(
        waiting.select("doc_id", "row_hash", "text", "runs").mapInArrow(
            lambda batches: _packed(batches, window),
            "minimiser long, hot boolean, digest binary, string binary, low_doc long, "
            "doc_id long, row_hash long, start long",
        ),
        "super-kmers",
    )
    buckets = (
        packed.filter(~F.col("hot") & F.col("string").isNotNull())
        .select("minimiser", "digest", "string", "low_doc")
        .repartition("minimiser")
        .sortWithinPartitions("minimiser")
        .mapInArrow(lambda batches: _count(batches, window), "digest binary, firsts array<long>")
    )
    hot = _hot_firsts(packed, window)
    starts = F.expr("transform(filter(sequence(0, size(firsts) - 1), j -> firsts[j] < doc_id), j -> start + j)")
    gone = (
        packed.select("digest", "doc_id", "row_hash", "start")
        .join(buckets.unionByName(hot), "digest")
        .select("doc_id", "row_hash", starts.alias("starts"))
        .filter(F.size("starts") > 0)
        .groupBy("doc_id", "row_hash")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    cut = (
        waiting.select("doc_id", "row_hash", "text", "n_words")
        .join(gone, ["doc_id", "row_hash"], "left")
        .select("doc_id", "text", "starts", "n_words")
        .mapInArrow(
            lambda batches: _close(batches, window),
            "doc_id long, n_removed long, kept_sha256 string, "
            "removed array<struct<from:bigint,to:bigint>>, n_words long",
        )
    )
    order = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
    untouched = opened.filter(F.col("runs").isNull()).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.array().cast("array<struct<from:bigint,to:bigint>>").alias("removed"),
    )
    return untouched.unionByName(cut.select(*order))


def kept_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): what is left of documents with unique ids, words joined by one space."""
    kept = F.filter(
        words(F.col("text")),
        lambda w, i: ~F.exists(F.col("removed"), lambda s: (i >= s["from"]) & (i < s["to"])),
    )
    return docs.select("doc_id", "text").join(spans.select("doc_id", "removed"), "doc_id").select(
        "doc_id", F.array_join(kept, " ").alias("text")
    )
