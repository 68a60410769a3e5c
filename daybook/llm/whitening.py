"""Whitening of embeddings: principal components of the distinct vectors, scaled to unit variance.

Chan merging.  Each partition of the distinct vectors computes its count, mean and centred scatter, batch by batch; two
such moments merge by the pairwise formula, in the partition and then in ``treeReduce``.  Only moments reach the driver,
dims squared numbers however many vectors there are; it takes the eigenvectors.  A second pass over the distinct vectors
gathers the moments of the whitened ones in the same way and holds their covariance against the identity.

Vectors are put on a grid first, x = floor(64 * c) + 1000000, so that equal vectors are equal and sums are exact.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are those of another
length than most distinct vectors have (of two as frequent, the shorter); rows that repeat are returned each; ties among
eigenvalues give any basis of their space, the same for all rows; components without variance (below the rounding of the
largest) can't be whitened and aren't returned; an empty table gives an empty result; a ``deviation`` that no long holds
is null.  Entries are clipped to 2**52 on the grid, where doubles are still whole.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The grid: steps a unit, and the shift that makes usual entries positive.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
_BOUND = float(2**52)


@dataclass
class Moments:
    """Count, exact sums (where the vectors are whole), mean and centred scatter of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of ``x``; whole numbers are moved near their mean as such, so that no digit is lost."""
        if x.dtype == np.int64:
            base = x[0]
            shifted = (x - base).astype(np.float64)
            parts = [x[i : i + 512].sum(axis=0) for i in range(0, len(x), 512)]  # 512 entries below 2**53 fit in a long
            sums = [sum(map(int, p)) for p in zip(*parts, strict=True)]
        else:
            base, shifted, sums = np.zeros(x.shape[1]), x, []
        mean = shifted.mean(axis=0)
        centred = shifted - mean
        return cls(len(x), sums, base + mean, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if self.sums:  # exact: a difference of means far from zero would lose digits
            apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        else:
            apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + apart * (other.n / n), scatter)


#: Moments by length of vector.
ByLength = dict[int, Moments]


def _merged(a: ByLength, b: ByLength) -> ByLength:
    return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in {**a, **b}}


def matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column of lists: for each length, the rows that have it and their matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    found = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        found.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return found


def _gathered(prepare=None):
    """A function from Arrow batches of (x) to one row, the partition's moments pickled."""
    def run(batches):
        total: ByLength = {}
        for batch in batches:
            for _, x in matrices(batch.column("x")):
                x = x.astype(np.int64) if prepare is None else prepare(x)
                if x is not None:
                    total = _merged(total, {x.shape[1]: Moments.of(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)])], ["moments"])

    return run


def moments(vectors: DataFrame, prepare=None) -> ByLength:
    """Moments of column x over all rows: one row a partition, then merged in pairs as a tree."""
    partial = vectors.select("x").mapInArrow(_gathered(prepare), "moments binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    # depth follows the number of partitions, so that no task merges more than about 32
    depth = max(2, int(np.ceil(np.log(max(2, partial.getNumPartitions())) / np.log(32))))
    return partial.treeReduce(_merged, depth) if partial.getNumPartitions() else {}


@dataclass
class Whitening:
    """Components fitted on the distinct vectors: all that a row needs to be whitened."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray  # one column a component
    values: np.ndarray
    total: float
    identity_error: float = float("nan")

    @classmethod
    def of(cls, m: Moments, components: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        values, vectors = values[::-1], vectors[:, ::-1]
        usable = values > max(values[0], 0) * len(values) * np.finfo(float).eps
        values, vectors = values[usable][:components], vectors[:, usable][:, :components]
        # either sign would do; the largest entry is positive, so that reruns agree
        if vectors.size:
            vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        return cls(m.n, m.sums, np.array([s / m.n for s in m.sums]), vectors, values, float(np.trace(m.scatter) / m.n))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with the whole part taken off first, as whole numbers."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([(s - s // self.n * self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n * x - S) ** 2, exact whatever their size; None where no long holds one."""
        whole = np.array([s // self.n for s in self.sums])
        off = x - whole  # small whole numbers
        rest = [s - s // self.n * self.n for s in self.sums]
        furthest = int(np.abs(off).max(initial=0)) * self.n + self.n
        if furthest < 2**31 and furthest * furthest * x.shape[1] < 2**63:
            y = off * self.n - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        sums = (sum((int(a) * self.n - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in off)
        return [s if s < 2**63 else None for s in sums]


def finite(column: str) -> Column:
    entry = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  (NaN is greater than any number)
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, entry)


def on_grid(column: str) -> Column:
    place = lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEPS, F.lit(_BOUND)), F.lit(-_BOUND))) + SHIFT
    return F.transform(column, place)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[int, Whitening] | None:
    """Fit on the distinct vectors of ``x``: their length and the whitening; None where there are none."""
    distinct = common.materialise(vectors.select("x").distinct(), "distinct")
    found = moments(distinct)
    if not found:
        return None
    length = min(found, key=lambda d: (-found[d].n, d))
    fitted = Whitening.of(found[length], components)
    check = moments(distinct, lambda x: fitted.apply(x) if x.shape[1] == length else None)
    common.discard(distinct)
    m = check[fitted.vectors.shape[1]]
    fitted.identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max(initial=0))
    return length, fitted


def _whitened(length: int, model: Whitening):
    def run(batches):
        for batch in batches:
            for rows, x in matrices(batch.column("x")):
                if x.shape[1] != length:
                    continue
                k = model.vectors.shape[1]
                ids = batch.column("vec_id").take(pa.array(rows))
                repeated = pa.array(np.repeat(np.arange(len(rows)), k))
                fixed = lambda v, t: pa.array(np.tile(v, len(rows)), t)
                yield pa.RecordBatch.from_arrays([
                    ids.take(repeated), fixed(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(rows) * k, model.n), pa.int64()),
                    pa.array(model.deviations(x), pa.int64()).take(repeated), pa.array(model.apply(x).ravel()),
                    fixed(model.values / model.total, pa.float64()), pa.array(np.full(len(rows) * k, model.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    The distinct vectors are shuffled once and written; then the table is read again, without a shuffle.
    """
    rows = embeddings.where(finite(f"`{column}`")).select(F.col(f"`{key}`").cast("long").alias("vec_id"), on_grid(f"`{column}`").alias("x"))
    fitted = fit(rows, components)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return rows.mapInArrow(_whitened(*fitted), SCHEMA)
