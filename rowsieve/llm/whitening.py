"""Whitening of embeddings: covariances by polarisation, from exact sums of squares."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsieve.session import settle

#: Entries of a vector are this many steps to the unit, rounded down.
STEPS = 256
#: Rows whose pair sums are squared at once.
STRIP = 2048
#: Eigenvalues up to this share of the trace count as zero: nothing to whiten there.
NO_SPREAD = 1e-13


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x): vectors without null and non-finite entries, as whole steps."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.col("v").isNotNull())
        .filter(F.forall("v", fine))
        .select(
            "vec_id",
            F.size("v").alias("dim"),
            F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"),
        )
    )


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
        yield int(dim), rows


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x less the centre, as 64-bit numbers where those hold it, else as Python integers."""
    low = min(centre, default=0), int(x.min(initial=0))
    high = max(centre, default=0), int(x.max(initial=0))
    if max(map(abs, (*low, *high))) < 1 << 61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _holds(y: np.ndarray, terms: int, most_else: int = 0) -> np.ndarray:
    """y as it is if sums of so many products of two entries, or of one and ``most_else``, fit
    64 bits; else as Python integers."""
    if y.dtype == object:
        return y
    most = int(np.abs(y).max(initial=0))
    return y if terms * most * max(most, most_else) < 1 << 62 else y.astype(object)


def _digits(values: np.ndarray) -> list[str]:
    return [str(v) for v in values.tolist()]


def _sums(fit: DataFrame, per_batch, name: str) -> DataFrame:
    """(dim, i, sums): element-wise exact sums of the arrays ``per_batch`` gives for a matrix.

    Each task adds up its rows; the arrays of one (dim, i) meet in one task, which holds a
    single array for it. Sums travel as digits, so no size overflows them.
    """
    schema = "dim int, i int, sums array<string>"

    def emit(totals: dict) -> pa.RecordBatch:
        keys = sorted(totals)
        return pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([_digits(totals[k]) for k in keys], pa.list_(pa.string())),
            ],
            ["dim", "i", "sums"],
        )

    def add(totals: dict, key: tuple, part: np.ndarray) -> None:
        totals[key] = totals[key] + part.astype(object) if key in totals else part.astype(object)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for dim, rows in _by_dim(batch):
                x = _matrix(rows.column("x"), dim)
                for a in range(0, len(x), STRIP):
                    for i, part in per_batch(dim, x[a : a + STRIP]):
                        add(totals, (dim, i), part)
        yield emit(totals)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for dim, i, digits in zip(*(c.to_pylist() for c in batch.columns)):
                add(totals, (dim, i), np.array([int(d) for d in digits], object))
        yield emit(totals)

    rows = fit.select("dim", "x").mapInArrow(partial, schema)
    return settle(rows.repartition("dim", "i").mapInArrow(merge, schema), name)


@dataclass(frozen=True)
class Whitener:
    """What whitens the vectors of one length, from exact sums over the fit list."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S over n, in doubles: the whole part of the mean is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole)])
        return _less(x, whole).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, unit variance each; NaN where there is no spread."""
        spread = np.where(self.eigenvalues > NO_SPREAD * self.trace, self.eigenvalues, np.nan)
        return self.centred(x) @ self.components / np.sqrt(spread)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2, exactly.

        With y = x - w and r = S - n * w for the whole means w, it is
        n^2 * sum(y^2) - 2 * n * sum(r * y) + sum(r^2).
        """
        whole = [s // self.n for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole)]
        y = _holds(_less(x, whole), len(rest), most_else=max(rest, default=0))
        squares = (y * y).sum(axis=1).tolist()
        cross = (y * np.array(rest, y.dtype)).sum(axis=1).tolist()
        n, last = self.n, sum(r * r for r in rest)
        return [n * n * s - 2 * n * c + last for s, c in zip(squares, cross)]


def fit_whiteners(fit: DataFrame, n_components: int) -> dict[int, Whitener]:
    """A whitener for each vector length in the fit list (dim, x).

    First the exact sums of every dimension. Then, by polarisation, the exact sums of squares
    of every centred dimension and of every sum of two of them: 2 cov(a, b) is the variance of
    a + b less those of a and b. Values are centred at the whole part w of the mean before they
    are squared; what the rest r / n of the mean adds is known exactly, as the sum of
    (n * x - S)^2 is n^2 * sum((x - w)^2) - n * r^2. The driver sees one d by d matrix a length.
    """

    def totals_of(dim: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        held = _holds(x, len(x)) if len(x) and int(x.min()) > -(1 << 63) else x.astype(object)
        yield -1, np.array([len(x), *held.sum(axis=0)], object)

    rows = _sums(fit, totals_of, "sums").collect()
    sums = {r["dim"]: [int(d) for d in r["sums"]] for r in rows}
    counts = {dim: values[0] for dim, values in sums.items()}
    totals = {dim: values[1:] for dim, values in sums.items()}
    centres = {d: [s // counts[d] for s in values] for d, values in totals.items()}

    def squares(dim: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        y = _holds(_less(x, centres[dim]), 4 * len(x))  # pair sums are twice as large
        for i in range(dim):
            pair = y[:, i : i + 1] + y[:, i:]
            pair[:, 0] = y[:, i]  # the dimension by itself
            yield i, (pair * pair).sum(axis=0)

    found: dict[int, Whitener] = {}
    tables: dict[int, dict[int, list[int]]] = {}
    for r in _sums(fit, squares, "pair-squares").collect():
        tables.setdefault(r["dim"], {})[r["i"]] = [int(d) for d in r["sums"]]
    for dim, table in tables.items():
        n = counts[dim]
        rest = [s - n * w for s, w in zip(totals[dim], centres[dim])]
        alone = [n * table[i][0] - rest[i] ** 2 for i in range(dim)]
        cov = np.empty((dim, dim))
        for i in range(dim):
            cov[i, i] = alone[i] / n**2
            for j in range(i + 1, dim):
                both = n * table[i][j - i] - (rest[i] + rest[j]) ** 2
                cov[i, j] = cov[j, i] = (both - alone[i] - alone[j]) / (2 * n**2)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:n_components]
        chosen = vectors[:, order]
        sign = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))])
        found[dim] = Whitener(
            n, totals[dim], np.maximum(values[order], 0.0), chosen * sign, sum(alone) / n**2
        )
    return found


def identity_error(fit: DataFrame, whiteners: dict[int, Whitener], n_components: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity.

    One value over all vector lengths; components without spread take no part.
    """

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                if dim in whiteners:
                    w = whiteners[dim].whiten(_matrix(rows.column("x"), dim))
                    full = np.full((len(w), n_components), np.nan)
                    full[:, : w.shape[1]] = w
                    cols = [pa.array(c, from_pandas=True) for c in full.T]
                    yield pa.record_batch(
                        [rows.column("dim"), *cols], ["dim", *[f"w{i}" for i in range(n_components)]]
                    )

    names = [f"w{i}" for i in range(n_components)]
    rows = fit.select("dim", "x").mapInArrow(
        whiten, "dim int, " + ", ".join(f"{c} double" for c in names)
    )
    off = [
        F.abs(F.covar_pop(a, b) - (1.0 if a == b else 0.0))
        for i, a in enumerate(names)
        for b in names[i:]
    ]
    # A first column of zero keeps greatest() defined for a single component.
    worst = rows.groupBy("dim").agg(F.greatest(*off, F.lit(0.0)).alias("off"))
    return worst.agg(F.max("off")).first()[0]


def whiten(vectors: DataFrame, n_components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector.

    ``vectors`` holds vec_id and embedding. Entries become whole steps floor(256 * c); each
    different vector counts once in the fit. Components are numbered from 1 by falling
    eigenvalue, the largest entry of each positive; up to ``n_components`` a vector, fewer if it
    is shorter. deviation is decimal(38, 0), null beyond that. A component without spread (all
    vectors equal, or fewer vectors than components) has a null ``whitened``, and ``explained`` is
    null if nothing varies. Vectors of different length are fitted by themselves. Null vectors and
    those with null or non-finite entries are left out, ids may be null or repeat, empty vectors
    and an empty table give no rows, extra columns are not read. Entries past 64 bits are held
    at the largest 64-bit step.
    """
    usable = usable_vectors(vectors).filter("dim > 0")
    fit = settle(usable.select("dim", "x").distinct(), "whitening-fit")
    whiteners = fit_whiteners(fit, n_components)
    error = identity_error(fit, whiteners, n_components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                x, tool = _matrix(rows.column("x"), dim), whiteners[dim]
                white = tool.whiten(x)
                many = white.shape[1]
                exact = [str(v) for v in tool.deviations(x)]
                explained = tool.eigenvalues / tool.trace if tool.trace > 0 else [None] * many
                yield pa.record_batch(
                    [
                        rows.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), many))),
                        pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()),
                        pa.array([tool.n] * (many * len(x)), pa.int64()),
                        pa.array([e for e in exact for _ in range(many)], pa.string()),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array([*explained] * len(x), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), "dim", "x").mapInArrow(
        apply, "vec_id long, component int, n long, deviation string, whitened double, explained double"
    )
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38, 0))")).withColumn(
        "identity_error", F.lit(error).cast("double")
    )
