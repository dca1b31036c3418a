"""N-gram Jaccard join: MinHash bands find families of texts, full n-gram sets decide the links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.common import connected_components, words
from rowsieve.session import settle

WORDS = 5
SIMILARITY = 0.8
#: Share of the pairs just at the similarity that must meet in a band.
RECALL = 0.9999
MOST_HASHES = 128
#: Texts in one block of a large family; two blocks are compared in one task.
BLOCK = 256
#: N-grams, about, in one task of small families.
TASK_GRAMS = 100_000
#: Width of a size class; links only reach a few classes up or down.
SIZE_STEP = 1.05
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def choose_bands(
    similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES
) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at ``similarity`` still share a band
    with probability ``recall``, 1 - (1 - s^rows)^bands, within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall within so many hashes")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@np.errstate(over="ignore")
def gram_sets(word_hashes: np.ndarray, at: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """The sorted n-gram set of each text, as 64-bit hashes of its words' hashes.

    ``at`` holds the bounds of the texts. A text with fewer words is one n-gram of them all; one
    without words has an empty set.
    """
    flat = word_hashes.astype(np.int64).view(np.uint64)
    n = len(flat)
    factors = [_ODD[k % 5] * np.uint64(2 * (k // 5) + 1) for k in range(width)]
    grams = np.zeros(max(0, n - width + 1), np.uint64)
    # With fewer words in all than an n-gram has, the slices' ends would count from behind.
    for k in range(width if n >= width else 0):
        grams += flat[k : n - width + 1 + k] * factors[k]
    grams = _mix(grams)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short += flat[a + k] * factors[k]
            sets.append(_mix(short + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """One hash for each (non-empty set, band): its ``rows`` minimum hashes together."""
    rng = np.random.default_rng(seed)
    scale = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), bands), np.uint64)
    for i in range(bands * rows):
        least = np.minimum.reduceat(flat * scale[i] + shift[i], at)
        band = i // rows
        out[:, band] = _mix(out[:, band] * _ODD[0] + least + np.uint64(band))
    return out.view(np.int64)


def _hashed_words(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the 64-bit hash of each word in order, made where the text is read."""
    return docs.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))


def _slices(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with about ``most`` words: (from, to, word hashes, bounds)."""
    column = batch.column(batch.num_columns - 1)
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        b = min(b, batch.num_rows)
        yield a, b, flat[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_key, n, bands) for each row; texts without words have a null set_key.

    ``set_key`` is a 128-bit digest of the n-gram set and ``n`` its size.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, at in _slices(batch):
                sets = gram_sets(flat, at, width)
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands, rows) if full else ())
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(
                            [_digest(s) if len(s) else None for s in sets], pa.binary()
                        ),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(
                            [next(hashes) if len(s) else None for s in sets], pa.list_(pa.int64())
                        ),
                    ],
                    ["doc_id", "set_key", "n", "bands"],
                )

    return _hashed_words(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        sign, "doc_id long, set_key binary, n long, bands array<long>"
    )


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def links_inside(sets: list[np.ndarray], similarity: float, split: int | None = None) -> np.ndarray:
    """Which pairs of sets reach the similarity, as a matrix without its diagonal.

    ``split``: only pairs of one set before and one set from there on. N-grams of one set alone
    do not count; the others are multiplied in strips of bounded size.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    grams, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], column[shared]
    number = np.cumsum(counts > 1) - 1
    column = number[column]
    left = np.arange(m) if split is None else np.arange(split)
    right = np.arange(m) if split is None else np.arange(split, m)
    both = np.zeros((len(left), len(right)), np.float64)
    width = int((counts > 1).sum())
    step = max(1, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, width, step):
        b = min(width, a + step)
        i, j = np.searchsorted(column, [a, b])
        strip = np.zeros((m, b - a), np.float32)
        strip[owner[i:j], column[i:j] - a] = 1
        both += strip[left] @ strip[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    linked = both >= similarity * union - 1e-9
    if split is None:
        np.fill_diagonal(linked, False)
    return linked


def _roots(nodes: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by links."""
    root = nodes.copy()
    while True:
        before = root.copy()
        for i in np.flatnonzero(linked.any(axis=1)):
            to = right[linked[i]]
            least = min(root[left[i]], root[to].min())
            root[left[i]] = least
            root[to] = np.minimum(root[to], least)
        if (root == before).all():
            return root


def _task_links(part: pa.Table, similarity: float) -> pa.Table:
    """Links of one task: each family (or pair of blocks) by itself."""
    frame = part.to_pandas().drop_duplicates(["family", "side", "node", "set_key"])
    out: list[tuple] = []
    for _, rows in frame.sort_values(["family", "side", "node"]).groupby("family", sort=False):
        sets = [np.frombuffer(s, np.uint64) for s in rows["grams"]]
        nodes, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        # Side 0 and 1 of a pair of blocks; a family or block by itself is all side 0.
        split = int((rows["side"] == 0).sum())
        one = split == len(rows) and not rows["paired"].any()
        if len(rows) < 2 or (not one and split in (0, len(rows))):
            continue
        linked = links_inside(sets, similarity, None if one else split)
        left = np.arange(len(rows)) if one else np.arange(split)
        right = np.arange(len(rows)) if one else np.arange(split, len(rows))
        n_sets, n_docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        n_sets[left] += linked.sum(axis=1)
        n_docs[left] += linked @ copies[right]
        if not one:
            n_sets[right] += linked.sum(axis=0)
            n_docs[right] += linked.T @ copies[left]
        root = _roots(nodes, left, right, linked)
        has = n_sets > 0
        out += list(zip(nodes[has].tolist(), n_sets[has].tolist(), n_docs[has].tolist(), root[has].tolist()))
    cols = list(zip(*out)) or [[]] * 4
    return pa.table(
        [pa.array(c, pa.int64()) for c in cols], names=["node", "n_sets", "n_docs", "root"]
    )


def _tasks(members: DataFrame, similarity: float, block: int, task_grams: int) -> DataFrame:
    """(node, set_key, copies, family, task, side, paired): where each text is compared.

    Small families share tasks by a hash, whole. A family of more than ``block`` texts is cut in
    blocks of a size class and a hash; two blocks meet in one task if their sizes allow a link.
    """
    reach = math.ceil(math.log(1 / similarity) / math.log(SIZE_STEP))
    sized = members.withColumn(
        "size_class", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).cast("int")
    )
    counts = settle(
        sized.groupBy("family", "size_class").agg(
            F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams")
        ),
        "family-sizes",
    )
    totals = counts.groupBy("family").agg(F.sum("m").alias("family_m"))
    all_grams = counts.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    tasks = max(1, all_grams // task_grams)
    sized = sized.join(totals, "family")
    plain = ["node", "set_key", "copies", "family"]
    small = sized.filter(F.col("family_m") <= block).select(
        *plain,
        F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("task"),
        F.lit(0).alias("side"),
        F.lit(False).alias("paired"),
    )
    large = totals.filter(F.col("family_m") > block)
    cells = counts.join(large, "family", "left_semi").select(
        "family", "size_class", F.ceil(F.col("m") / block).cast("long").alias("cuts")
    )
    blocks = cells.select(
        "family", "size_class", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
    )
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(
        b,
        (F.col("a.family") == F.col("b.family"))
        & (F.col("b.size_class") - F.col("a.size_class")).between(0, reach)
        & ((F.col("a.size_class") < F.col("b.size_class")) | (F.col("a.cut") <= F.col("b.cut"))),
    ).select(
        F.col("a.family").alias("family"),
        F.xxhash64("a.family", "a.size_class", "a.cut", "b.size_class", "b.cut").alias("task"),
        F.array(
            F.struct(F.col("a.size_class").alias("size_class"), F.col("a.cut").alias("cut"), F.lit(0).alias("side")),
            F.struct(F.col("b.size_class").alias("size_class"), F.col("b.cut").alias("cut"), F.lit(1).alias("side")),
        ).alias("ends"),
        ((F.col("a.size_class") != F.col("b.size_class")) | (F.col("a.cut") != F.col("b.cut"))).alias("paired"),
    )
    ends = pairs.select("family", "task", "paired", F.explode("ends").alias("end")).filter(
        F.col("paired") | (F.col("end.side") == 0)
    ).select("family", "task", "paired", F.col("end.size_class").alias("size_class"),
             F.col("end.cut").alias("cut"), F.col("end.side").alias("side"))
    big = (
        sized.join(cells, ["family", "size_class"])
        .withColumn("cut", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")))
        .join(ends, ["family", "size_class", "cut"])
        .select(*plain, "task", "side", "paired")
    )
    return small.unionByName(big)


def jaccard_links(
    docs: DataFrame,
    width: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK,
    task_grams: int = TASK_GRAMS,
) -> DataFrame:
    """(doc_id, class_id, set_id, n_links) for each row of ``docs`` (doc_id, text).

    Texts link if the Jaccard similarity of their sets of ``width``-word n-grams is at least
    ``similarity``; words are compared as they are. ``set_id`` is the smallest doc_id with the
    same n-gram set, ``n_links`` the number of other rows linked (copies of the set included),
    ``class_id`` the smallest doc_id reached by links.

    1. Equal sets become one node, counted before the shuffle: thousands of copies cost one row.
    2. Nodes are shuffled on band hashes; each bucket links its members to its smallest, so a
       bucket of m costs m rows. Connected by these, nodes form families; every candidate pair
       lies inside one.
    3. A family is compared in whole on full n-gram sets, small ones many to a task, large ones
       in pairs of blocks. A task multiplies set matrices and returns one row a node: how many
       links, and the smallest node reached. Pairs are never written.

    Work inside a family of m different texts is m² / 2 comparisons, spread over (m / block)² / 2
    tasks; size classes leave out pairs of blocks that cannot link. A pair at the similarity is
    missed with probability 1 - ``recall`` at most. Texts with fewer words than ``width`` are one
    n-gram. Rows without words, or with a null doc_id, link to nothing and are their own class
    (a null id: null). Repeated rows are copies; different texts under one doc_id share a node.
    """
    bands, rows = choose_bands(similarity, recall)
    signed = settle(signatures(docs, width, bands, rows), "signatures")
    named = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    nodes = settle(
        named.groupBy("set_key").agg(
            F.min("doc_id").alias("node"),
            F.first("n").alias("n"),
            F.count(F.lit(1)).alias("copies"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = (
        banded.groupBy("band")
        .agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("head"))
        .filter("m > 1")
        .select("band", "head")
    )
    stars = banded.join(buckets, "band").filter("node <> head").select("node", "head")
    families = connected_components(stars, "node", "head", "families")
    families = families.withColumnRenamed("component", "family")
    members = settle(
        nodes.select("node", "set_key", "n", "copies").join(families, "node"), "members"
    )
    tasks = settle(_tasks(members, similarity, block, task_grams), "tasks")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            keys = batch.column(names.index("set_key")).to_pylist()
            for a, b, flat, at in _slices(batch):
                sets = gram_sets(flat, at, width)
                same = np.flatnonzero([_digest(s) == k for s, k in zip(sets, keys[a:b])])
                part = batch.slice(a, b - a).take(pa.array(same))
                yield pa.record_batch(
                    [*part.columns[:-1], pa.array([sets[i].tobytes() for i in same], pa.binary())],
                    [*names, "grams"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Merged at every size: the tasks grow with the corpus, so texts are dealt to them by id.
    placed = texts.join(tasks.hint("merge"), F.col("doc_id") == F.col("node"))
    columns = ["node", "set_key", "copies", "family", "task", "side", "paired"]
    with_sets = _hashed_words(placed, *columns).mapInArrow(
        grams,
        "node long, set_key binary, copies long, family long, task long, side int, "
        "paired boolean, grams binary",
    )
    linked = settle(
        with_sets.groupBy("task").applyInArrow(
            lambda part: _task_links(part, similarity),
            "node long, n_sets long, n_docs long, root long",
        ),
        "links",
    )
    classes = connected_components(linked, "node", "root", "classes")
    per_node = linked.groupBy("node").agg(F.sum("n_docs").alias("n_docs"))
    resolved = (
        nodes.select("set_key", "node", "copies")
        .join(per_node, "node", "left")
        .join(classes, "node", "left")
        .select(
            "set_key",
            F.col("node").alias("set_id"),
            F.coalesce("component", "node").alias("class_id"),
            (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    taking_part = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    return (
        signed.select("doc_id", taking_part.alias("its_key"))
        .join(resolved, F.col("its_key") == F.col("set_key"), "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("set_id", "doc_id").alias("set_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stands for their class, and all rows with a null id.

    Of rows with equal id and text one stays; different texts under one id all stay. The row
    travels in one column, so names of its columns meet none of those made here.
    """
    heads = links.filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumns(
        {"doc_id": F.col("row.doc_id"), "text_hash": F.sha2(F.col("row.text").cast("binary"), 256)}
    )
    named = rows.join(heads.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text_hash"])
    return named.select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))
