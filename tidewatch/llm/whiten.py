"""Embedding whitening: moments merged pairwise over partitions, components from their covariance, and a second pass that verifies them.

Each partition folds its vectors, block by block, into a count, a mean and a scatter centred on that mean;
two such states merge by Chan's formula, in a partition and then over all partitions by ``treeReduce``. The driver gets
one state (d x d numbers for vectors of d entries, whatever their number), and its eigenvectors are the components.
The second pass projects all vectors and folds the projections in the same way: their covariance must be the identity.

Defined results: a vector that is null or holds a null, NaN or infinite entry is left out (``usable``); repeated rows and
ids count as often as they come, a null id stays null; an empty table, or one without a usable vector, gives no rows; vectors of
different lengths are whitened apart, each length by its own fit, and empty ones have no components. A component without
variance (all vectors equal along it, as for one vector) has null where its whitened values would be, and no share in
the identity error; that is null where no component has variance. Components come by falling variance, each with its largest entry positive.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that are centred and multiplied at once.
BLOCK = 2048
#: Integer entries are summed in two halves, so that sums are exact up to 2^31 vectors of any entries.
HALF = 31
#: Grid entries lie within this, whatever the vector's.
MOST_ENTRY = 1 << 62


@dataclass
class Moments:
    """Count, exact sums (of integers), mean, and the scatter around that mean."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        n, delta = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, self.high + other.high, self.low + other.low, self.mean + delta * (other.n / n), scatter)

    @property
    def sums(self) -> list[int]:
        return [(int(h) << HALF) + int(x) for h, x in zip(self.high, self.low, strict=True)]


@dataclass
class Fit:
    """What whitens vectors of one length: exact sums, components as rows, their variances, and the whole variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """What projections are multiplied by: 1 over the deviation, NaN without variance (in double precision)."""
        floor = self.trace * len(self.mean) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > floor, 1 / np.sqrt(self.variances), np.nan)

    def project(self, block: np.ndarray) -> np.ndarray:
        return ((block - self.mean) @ self.components.T) * self.scales


def usable(column: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.forall(F.col(f"`{column}`"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def grid(column: str, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset as long; entries beyond 2^62 count as that, with their sign."""
    at = lambda c: c.cast("double") * scale
    far = float(MOST_ENTRY >> 1)
    return F.transform(F.col(f"`{column}`"), lambda c: F.when(F.abs(at(c)) < far, F.floor(at(c)) + F.lit(offset).cast("long")).otherwise(F.when(c > 0, F.lit(MOST_ENTRY)).otherwise(F.lit(-MOST_ENTRY))))


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: (their places, the vectors as a matrix)."""
    lengths = np.diff(column.offsets.to_numpy())
    values, first = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    values = values.astype(np.int64 if values.dtype.kind == "i" else np.float64, copy=False)
    for d in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == d)
        for lo in range(0, len(where), BLOCK):
            rows = where[lo : lo + BLOCK]
            yield rows, values[(first[rows, None] + np.arange(d))]


def block_moments(block: np.ndarray) -> Moments:
    n, d = block.shape
    if block.dtype.kind == "i":
        high, low = (block >> HALF).sum(axis=0), (block & ((1 << HALF) - 1)).sum(axis=0)
        mean = (high * float(1 << HALF) + low) / n
    else:
        high = low = np.zeros(d, np.int64)
        mean = block.mean(axis=0)
    centred = block - mean
    # what rounding has left in the mean goes to the mean, so that the scatter is around it
    rest = centred.mean(axis=0)
    centred = centred - rest
    return Moments(n, high, low, mean + rest, centred.T @ centred)


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in {*a, *b}}


def moments(vectors: DataFrame, column: str, project: dict[int, Fit] | None = None) -> dict[int, Moments]:
    """The moments of all vectors (arrays without nulls) by their length; with ``project`` those of the vectors that a fit makes of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Moments] = {}
        for batch in batches:
            for _, block in _blocks(batch.column(0)):
                d = block.shape[1]
                if project:
                    block = project[d].project(block)
                own = _merged(own, {d: block_moments(block)})
        for d, m in own.items():
            parts = [np.ascontiguousarray(x).tobytes() for x in (m.high, m.low, m.mean, m.scatter)]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.n], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], ["d", "n", "high", "low", "mean", "scatter"])

    def state(row) -> dict[int, Moments]:
        mean = np.frombuffer(row.mean)
        return {row.d: Moments(row.n, np.frombuffer(row.high, np.int64), np.frombuffer(row.low, np.int64), mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)))}

    states = vectors.select(F.col(f"`{column}`")).mapInArrow(each, "d int, n long, high binary, low binary, mean binary, scatter binary").rdd.map(state)
    # An empty state of the driver's own stands for a table without rows.
    return vectors.sparkSession.sparkContext.parallelize([{}], 1).union(states).treeReduce(_merged)


def fit(vectors: DataFrame, column: str, components: int | None = None) -> dict[int, Fit]:
    """A fit for each length of the vectors: all components, or the first ``components``, and the error that the second pass finds."""
    fits = {}
    for d, m in moments(vectors, column).items():
        variances, axes = np.linalg.eigh(m.scatter / m.n)
        order = np.argsort(-variances, kind="stable")[: d if components is None else components]
        axes = axes.T[order]
        if d:
            axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        fits[d] = Fit(m.n, m.sums, m.mean, axes, np.maximum(variances[order], 0), float(np.trace(m.scatter) / m.n))
    if fits:
        for d, m in moments(vectors, column, fits).items():
            live = ~np.isnan(fits[d].scales)
            gap = np.abs(m.scatter / m.n - np.eye(len(live)))[np.ix_(live, live)]
            fits[d].identity_error = float(gap.max()) if gap.size else None
    return fits


def _deviations(block: np.ndarray, own: Fit) -> list[int | None]:
    """The sum of (n * x - S)^2 over the entries of each row, exact; null beyond a long."""
    n, d = own.n, block.shape[1]
    most = max(abs(int(block.max())), abs(int(block.min()))) if block.size else 0
    largest = n * most + max(map(abs, own.sums), default=0)
    if largest < 1 << 62:
        gaps = block * n - np.array(own.sums, np.int64)
        if d * int(np.abs(gaps).max(initial=0)) ** 2 < 1 << 63:
            return (gaps * gaps).sum(axis=1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, own.sums, strict=True)) for row in block.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def transform(vectors: DataFrame, column: str, id_col: str, fits: dict[int, Fit]) -> DataFrame:
    """The id, ``n``, ``deviation`` (integer vectors; else null), and arrays by component: ``whitened``, ``explained``; and ``identity_error``."""
    whole = dict(vectors.dtypes)[column] in ("array<bigint>", "array<int>")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in _blocks(batch.column(1)):
                own = fits[block.shape[1]]
                made = own.project(block)
                share = [float(v) / own.trace if own.trace > 0 else None for v in own.variances]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array([own.n] * len(rows), pa.int64()),
                        pa.array(_deviations(block, own) if whole else [None] * len(rows), pa.int64()),
                        pa.array([[None if np.isnan(x) else x for x in row] for row in made.tolist()], pa.list_(pa.float64())),
                        pa.array([share] * len(rows), pa.list_(pa.float64())),
                        pa.array([own.identity_error] * len(rows), pa.float64()),
                    ],
                    ["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").alias("vector"))
    out = rows.mapInArrow(each, "id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", components: int | None = None) -> DataFrame:
    """``fit`` and ``transform`` of all usable vectors: a row for each."""
    kept = vectors.where(usable(column)).select(F.col(f"`{id_col}`"), F.col(f"`{column}`"))
    return transform(kept, column, id_col, fit(kept, column, components))
