"""Whitening of embeddings by a tall-and-skinny QR decomposition (TSQR).

Vectors are put on an integer grid, so that sums over all of them are exact.  Every task reduces its centred rows to one small
triangular factor R, factors are merged pair-wise up a tree, and the right singular vectors of the last R are the principal
directions.  No covariance of the rows is ever formed, and no task or driver holds more than a few factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import STATE, bound_batches, merged, state_of
from quarry.sources.tables import materialise

#: The grid: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this (either sign) count as this: all integers up to it are doubles.
LARGEST = 1 << 53
#: Rows of a block that is decomposed at once.
BLOCK_ROWS = 4096
#: Directions with less than this share of the largest singular value have no variance but rounding.
NO_VARIANCE = 1e-12


def usable(vector: str) -> Column:
    """Whether a vector is there, without null and non-finite entries."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def grid(vectors: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of longs on the grid."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):  # what overflows is beyond LARGEST too
        return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[np.ndarray]:
    """The grid rows of the first column of some batches, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield grid(batch.column(0).slice(at, rows))


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: number of rows, exact sums by dimension, all singular values by falling size, and directions (as rows)."""

    n: int
    sums: tuple[int, ...]
    singular: np.ndarray
    directions: np.ndarray

    @property
    def eigenvalues(self) -> np.ndarray:
        """Of the covariance with divisor n."""
        return self.singular**2 / max(self.n, 1)

    @property
    def explained(self) -> np.ndarray:
        """Each direction's share of the variance; 0 where there is none."""
        e = self.eigenvalues
        return e / e.sum() if e.sum() else e

    @property
    def varied(self) -> np.ndarray:
        return self.singular > NO_VARIANCE * max(self.singular.max(initial=0.0), 1.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centre(x, self.n, self.sums)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened coordinates of grid rows; 0 in directions without variance."""
        scale = np.where(self.varied, 1 / np.sqrt(np.where(self.varied, self.eigenvalues, 1.0)), 0.0)[:k]
        return self.centred(x) @ self.directions[:k].T * scale

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Of each grid row the sum of (n x - S)^2, exactly, as decimals; null where it has over 38 digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        d = x - whole
        most = int(np.abs(d).max(initial=0)) + 1
        if (self.n * most) ** 2 * max(1, x.shape[1]) < 1 << 63:
            wide = d * self.n - np.array(rest, np.int64)
            return pa.array((wide * wide).sum(axis=1)).cast(pa.decimal128(38, 0))
        sums = [sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in d]
        return pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def centre(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Rows less the mean: whole parts are subtracted as integers, so nothing is lost to the grid's shift."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


SUMS = pa.schema([("dims", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])


def exact_sums(rows: DataFrame, vector: str) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and sums by dimension, of the length that most vectors have (of equally many the longest).

    A task sends one row for each dimension; the driver gets as many rows as dimensions.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            for d in np.unique(sizes).tolist():
                own = batch.column(0).filter(pa.array(sizes == d))
                counts[d] = counts.get(d, 0) + len(own)
                held = totals.setdefault(d, [0] * d)
                for at in range(0, len(own), 512):  # so few that longs hold their sums
                    for i, s in enumerate(grid(own.slice(at, 512)).sum(axis=0).tolist()):
                        held[i] += s
        out = [(d, i, counts[d], Decimal(s)) for d, t in totals.items() for i, s in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(SUMS)], schema=SUMS)

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(add, "dims int, place int, n long, s decimal(38,0)")
    of_all = materialise(parts.groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "sums")
    best = of_all.groupBy("dims").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return 0, ()
    got = of_all.filter(F.col("dims") == best.dims).collect()
    return best.n, tuple(int(r.s) for r in sorted(got, key=lambda r: r.place))


def folded(rows: DataFrame, vector: str, step: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """One state for each task that has rows: ``step`` folds blocks of grid rows into it."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for x in blocks(batches):
            if len(x):
                state = step(state, x)
        if state is not None:
            yield state_of(state)

    return rows.select(F.col(vector).cast("array<double>")).mapInArrow(fold, STATE)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of some rows, d x d: with zero rows below where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def fit(rows: DataFrame, vector: str = "embedding") -> Whitening:
    """Fit on the usable vectors of ``rows``.  Exact sums, then one R for each task, then the tree, then the SVD of the last R."""
    bound_batches(rows.sparkSession)
    good = rows.filter(usable(vector)).select(vector)
    n, sums = exact_sums(good, vector)
    d = len(sums)
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)))

    def reduce_rows(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        c = centre(x, n, sums)
        return triangle(c if r is None else np.vstack([r, c]))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return triangle(np.vstack([a.reshape(d, d), b.reshape(d, d)]))

    r = merged(folded(good.filter(F.size(vector) == d), vector, reduce_rows), merge).reshape(d, d)
    _, singular, directions = np.linalg.svd(r)
    for row in directions:  # the sign is free: the largest entry is positive
        row *= -1.0 if row[np.abs(row).argmax()] < 0 else 1.0
    return Whitening(n, sums, singular, directions)


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", components: int | None = None, to: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The usable rows of ``df`` with ``to`` (whitened coordinates by falling eigenvalue) and ``deviation`` (decimal: sum of (n x - S)^2).

    Rows whose vector is null, empty, of another length than the model's, or holds null or non-finite entries are left out;
    repeated rows stay.  Entries beyond 2^43 count as 2^43.  Without variance in a direction its coordinate is 0.  Columns
    called like ``to`` or ``deviation`` are replaced, others kept.
    """
    bound_batches(df.sparkSession)
    k = min(len(model.sums), components or len(model.sums))
    shared = df.sparkSession.sparkContext.broadcast(model)  # d x d doubles

    @F.arrow_udf("struct<whitened: array<double>, deviation: decimal(38,0)>")
    def whiten(vectors: pa.Array) -> pa.Array:
        m = shared.value
        if not len(vectors) or not m.n:
            return pa.nulls(len(vectors), pa.struct([("whitened", pa.list_(pa.float64())), ("deviation", pa.decimal128(38, 0))]))
        x = grid(vectors)
        w = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(m.project(x, k).ravel()))
        return pa.StructArray.from_arrays([w, m.deviations(x)], names=["whitened", "deviation"])

    good = df.filter(usable(vector) & (F.size(vector) == len(model.sums)))
    names = {to.lower(), deviation.lower()}
    held = [F.col(c) for c in df.columns if c.lower() not in names]
    got = "w_"
    while got in {c.lower() for c in df.columns}:
        got += "_"
    return good.select(*held, whiten.asNondeterministic()(F.col(vector).cast("array<double>")).alias(got)).select(*held, F.col(f"{got}.whitened").alias(to), F.col(f"{got}.deviation").alias(deviation))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", components: int | None = None) -> float:
    """The largest absolute entry of (covariance of whitened rows - identity), over directions with variance; 0 without any.

    Means and centred products are folded by task and merged up the tree.
    """
    k = min(len(model.sums), components or len(model.sums))
    if not model.n or not k:
        return 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    def join(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        if a is None:
            return b
        n, mean, products = a[0] + b[0], None, None
        gap = b[1 : k + 1] - a[1 : k + 1]
        mean = a[1 : k + 1] + gap * (b[0] / n)
        products = a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], mean, products])

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = shared.value.project(x, k)
        mean = w.mean(axis=0)
        return join(state, np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]))

    good = df.filter(usable(vector) & (F.size(vector) == len(model.sums)))
    state = merged(folded(good, vector, step), join)
    error = np.abs(state[k + 1 :].reshape(k, k) / state[0] - np.eye(k))
    some = model.varied[:k]
    return float(error[np.ix_(some, some)].max(initial=0.0))
