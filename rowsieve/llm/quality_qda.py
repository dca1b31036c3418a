"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transformed statistics of a text, in the order of the vectors.
STATISTICS = [
    "log_words", "log_word_length", "log_word_spread", "upper", "symbols", "marks", "bars",
    "digits", "stops", "distinct_words", "distinct_pairs", "stutter", "repeated_lines", "log_line_length",
]
#: Share of the pooled covariance, then of its mean variance times unity, mixed into a class.
TO_POOLED, TO_SPHERE = 0.2, 0.02
#: Least variance of a statistic after scaling to unit variance over both classes.
LEAST_VARIANCE = 0.02
THRESHOLD = 0.7
#: Bytes without any marks that a text is thought longer by, so that shares of short texts are calm.
SMOOTH = 40
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&<>"


def statistics_of(text: str) -> list[float]:
    """The transformed statistics of one whole text; roots and logs tame their tails."""
    raw = text.encode("utf-8", "replace")
    w = raw.split()
    n, size = max(1, len(w)), max(1, len(raw))
    lengths = np.fromiter(map(len, w), np.int64, len(w)) if w else np.ones(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda k, of: (k / (of + SMOOTH)) ** 0.5
    lost = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    pairs = len(set(zip(w, w[1:])))
    return [
        np.log1p(len(w)),
        np.log(lengths.mean()),
        np.log1p(lengths.std()),
        share(lost(_UPPER), size),
        share(lost(_SYMBOLS), size),
        share(raw.count(b"!") + raw.count(b"?"), size),
        share(raw.count(b"|"), size),
        share(lost(b"0123456789"), size),
        share(raw.count(b".") + raw.count(b","), size),
        # Distinct words fall with length by a power of it; the log ratio is nearly linear.
        np.log(max(1, len(set(w)))) / np.log(n + 1),
        pairs / max(1, n - 1) if n > 1 else 1.0,
        sum(map(eq, w, w[1:])) / n,
        (len(lines) - len(set(lines))) / (len(lines) + 3),
        np.log1p(size / max(1, len(lines))),
    ]


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``x``, the statistics of each row's whole text (null: empty)."""
    kept = docs.select(*keep, "text")
    schema = kept.select(*keep).withColumn("x", F.array(F.lit(0.0))).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(t or "") for t in batch.column(len(keep)).to_pylist()]
            flat = pa.array(np.array(rows, float).ravel())
            at = pa.array(np.arange(0, len(flat) + 1, len(STATISTICS)), pa.int32())
            yield pa.record_batch(
                [*batch.columns[: len(keep)], pa.ListArray.from_arrays(at, flat)], [*keep, "x"]
            )

    return kept.mapInArrow(read, schema)


@dataclass
class Qda:
    """Class centres and inverse Cholesky factors of shrunken covariances, over scaled vectors."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row: the logistic of the difference of the class log densities and
        priors.

        Each Mahalanobis distance is a triangular product with the cached factor. The difference
        is divided by the root of the number of statistics, which keeps its sign and order and
        softens its ends.
        """
        scaled = (x - self.centre) / self.spread
        logs = [
            -0.5 * ((((scaled - mean) @ factor.T) ** 2).sum(axis=1) + log_det)
            for mean, factor, log_det in zip(self.means, self.factors, self.log_dets)
        ]
        margin = (logs[1] - logs[0] + self.log_odds) / len(self.centre) ** 0.5
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(
    labelled: DataFrame,
    label: str,
    to_pooled: float = TO_POOLED,
    to_sphere: float = TO_SPHERE,
    least: float = LEAST_VARIANCE,
) -> Qda | None:
    """Fits both classes on every row (x, label 0 or 1); None if a class has no rows.

    The driver gets two rows of sums, d + d² numbers each, however many rows are labelled. Rows
    with a null label are left out. Covariances are mixed with the pooled one and with a sphere.
    """
    d = len(STATISTICS)
    at = lambda i: F.get("x", F.lit(i))
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {
        int(r["label"]): r
        for r in labelled.filter(F.col(label).isin(0, 1))
        .groupBy(F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .collect()
    }
    if len(got) < 2:
        return None
    n = np.array([got[c]["n"] for c in (0, 1)], float)
    means = np.array([[got[c][f"s{i}"] for i in range(d)] for c in (0, 1)]) / n[:, None]
    second = np.zeros((2, d, d))
    for c in (0, 1):
        for i in range(d):
            for j in range(i + 1):
                second[c, i, j] = second[c, j, i] = got[c][f"p{i}_{j}"] / n[c]
    cov = second - means[:, :, None] * means[:, None, :]
    weight = n / n.sum()
    centre = weight @ means
    within = np.einsum("c,cij->ij", weight, cov)
    between = np.einsum("c,ci,cj->ij", weight, means - centre, means - centre)
    spread = np.sqrt(np.maximum(np.diag(within + between), 1e-12))
    cov, within = cov / np.outer(spread, spread), within / np.outer(spread, spread)
    means = (means - centre) / spread
    factors, log_dets = [], []
    for c in (0, 1):
        mixed = (1 - to_pooled) * cov[c] + to_pooled * within
        sphere = np.trace(mixed) / d
        mixed = (1 - to_sphere) * mixed + np.eye(d) * (to_sphere * sphere + least)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    odds = float(np.log(n[1] / n[0]))
    return Qda(centre, spread, means, np.array(factors), np.array(log_dets), odds)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: a checksum of the id leaves remainder 2 by 4. Null ids are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted and kept_row (all columns) for every row of ``docs``.

    Learns from the labelled rows that are not held out, all of them; ids, language, source and
    labels are no inputs of a score. A document with several labels counts once for each. Null
    texts score as empty ones. Without rows of both classes every score is 0.5. Extra columns
    travel in ``kept_row`` only, so their names cannot clash.
    """
    taught = labels.select(
        F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("its_label")
    ).filter(~held_out(F.col("label_id")) & F.col("its_label").isNotNull())
    # Statistics are joined to labels, not texts: what travels is a short vector.
    open_docs = docs.filter(~held_out(F.col("doc_id")))
    known = document_statistics(open_docs).join(taught, F.col("doc_id") == F.col("label_id"))
    model = fit(known, "its_label")
    source = docs.select("doc_id", F.struct(*docs.columns).alias("kept_row"), "text")
    schema = source.select("doc_id", "kept_row").withColumn("score", F.lit(0.0)).schema

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics_of(t or "") for t in batch.column(2).to_pylist()]
            made = model.score(np.array(x, float)) if model and x else np.full(len(x), 0.5)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(made, pa.float64())],
                ["doc_id", "kept_row", "score"],
            )

    return source.select("doc_id", "kept_row", "text").mapInArrow(rate, schema).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "kept_row",
    )
