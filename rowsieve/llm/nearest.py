"""Nearest neighbours by inner product: int8 tiles with error bounds, exact scores behind them."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsieve.session import settle

#: Vectors in one block of candidates and of queries; a tile is one of each.
BLOCK_ROWS = 4096
#: Candidates multiplied at once inside a tile.
STRIP = 1024
#: Products of int8 values summed in float32 are exact up to this many dimensions.
EXACT_DIMS = 1024


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim, row) of the vectors that take part.

    Null ids and vectors, vectors with a null or non-finite component and zero vectors stay out.
    ``row`` tells rows apart, with equal ids too: rows equal in id and vector are counted before
    the shuffle and numbered.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", fine))
        .filter(F.exists("v", lambda x: x != 0))
        .groupBy("vec_id", "v")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("vec_id", "v", "copy").alias("row"))
    )


class Quantised:
    """Rows as int8 with a scale each, and what rounding can cost: the norm of the rest."""

    def __init__(self, rows: np.ndarray):
        self.scale = np.abs(rows).max(axis=1) / 127.0
        # Scales of tiny vectors can underflow; such rows keep a bound that never prunes.
        safe = np.where(self.scale > 0, self.scale, 1.0)
        self.codes = np.rint(rows / safe[:, None]).clip(-127, 127).astype(np.int8)
        near = self.codes * safe[:, None]
        self.norm = np.sqrt((rows**2).sum(axis=1))
        self.near_norm = np.sqrt((near**2).sum(axis=1))
        self.rest = np.sqrt(((rows - near) ** 2).sum(axis=1))
        self.scale = safe


def tile_bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two blocks, from int8 products.

    |q·c - q'·c'| <= |q - q'| |c| + |q'| |c - c'|; a little is added for float rounding.
    """
    codes = np.zeros((len(q.codes), len(c.codes)))
    for a in range(0, q.codes.shape[1], EXACT_DIMS):
        part = slice(a, a + EXACT_DIMS)
        codes += q.codes[:, part].astype(np.float32) @ c.codes[:, part].astype(np.float32).T
    near = codes * q.scale[:, None] * c.scale[None, :]
    slack = q.rest[:, None] * c.norm[None, :] + q.near_norm[:, None] * c.rest[None, :]
    slack += 1e-9 * q.norm[:, None] * c.norm[None, :]
    return near - slack, near + slack


def search_tile(
    own: tuple[np.ndarray, np.ndarray],
    queries: np.ndarray,
    ids: np.ndarray,
    others: np.ndarray,
    rows: np.ndarray,
    k: int,
) -> list[list[tuple[float, int]]]:
    """For each query a heap of (score, -id): its k best rows of this tile but its own.

    ``own`` holds the queries' ids and row marks, ``ids`` and ``others`` those of the candidates.
    Strips of candidates are bounded by int8 products. A pair survives if its upper bound reaches
    the k-th best lower bound of the strip and the worst score of the query's full heap; only
    survivors are multiplied in double precision, dimension by dimension in order.
    """
    query_ids, query_rows = own
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    worst = np.full(len(query_ids), -np.inf)
    coded = Quantised(queries)
    for a in range(0, len(ids), STRIP):
        strip, strip_ids = rows[a : a + STRIP], ids[a : a + STRIP]
        low, high = tile_bounds(coded, Quantised(strip))
        itself = query_ids[:, None] == strip_ids[None, :]
        itself &= query_rows[:, None] == others[None, a : a + STRIP]
        low[itself] = -np.inf
        edge = worst.copy()
        if len(strip_ids) > k:
            np.maximum(edge, np.partition(low, -k, axis=1)[:, -k], out=edge)
        at, to = np.nonzero((high >= edge[:, None]) & ~itself)
        scores = np.zeros(len(at))
        for d in range(rows.shape[1]):
            scores += queries[at, d] * strip[to, d]
        for i, score, name in zip(at.tolist(), scores.tolist(), strip_ids[to].tolist()):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (score, -name))
            elif (score, -name) > heap[0]:
                heapq.heapreplace(heap, (score, -name))
        worst = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, all pairs considered.

    Queries are the rows whose id is divisible by ``every``; candidates all other rows of the
    same length, larger inner products first, ties to the smaller id. Where an id repeats, every
    row is a candidate, and a query of its own. Both sides are dealt to
    blocks by a hash of the row, about ``block_rows`` each, and every pair of blocks is one tile:
    a candidate travels once for each block of queries. A tile sends k rows a query at most, and
    ranking prunes again before the shuffle. Extra columns are not read; an empty table, or one
    without other vectors, gives no rows.
    """
    usable = settle(usable_vectors(vectors), "vectors")
    n, n_queries = usable.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))
    ).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_rows))
    block = lambda m: F.pmod(F.col("row"), F.lit(m))
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    key = ["dim", "block", "query_block"]
    rows = usable.withColumn("block", block(blocks)).withColumn("query_block", spread(query_blocks))
    asked = (
        usable.filter(F.col("vec_id") % every == 0)
        .withColumn("query_block", block(query_blocks))
        .withColumn("block", spread(blocks))
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, float]] = []
        if left.num_rows and right.num_rows:
            query_ids, query_rows, queries = _matrix(left)
            heaps = search_tile((query_ids, query_rows), queries, *_matrix(right), k)
            for name, row, heap in zip(query_ids.tolist(), query_rows.tolist(), heaps):
                found += [(name, row, -minus, score) for score, minus in heap]
        cols = list(zip(*found)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            [pa.array(c, t) for c, t in zip(cols, kinds)],
            names=["query_id", "query_row", "vec_id", "score"],
        )

    found = (
        asked.groupBy(*key)
        .cogroup(rows.groupBy(*key))
        .applyInArrow(tile, "query_id long, query_row long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids, rows = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], rows[order], flat.reshape(len(ids), -1)[order]


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.row_no <> c.row_no WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
