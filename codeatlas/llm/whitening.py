"""Whitening of embeddings by merged covariances.

Entries are put on a grid, x = floor(256 c), and each distinct x-vector counts once.  Of
these, every partition computes count, mean and centred scatter, batch by batch; two such
states merge by the pairwise formula

    n = a + b,  d = mean_b - mean_a,  mean = mean_a + d b / n,
    scatter = scatter_a + scatter_b + d d' a b / n

first within a partition and then in a ``treeReduce`` of the partitions, so the driver gets
a few states of D x D numbers whatever the table holds.  Sums of the integer entries travel
beside them as whole numbers, so deviations are exact.  The driver takes the eigenvectors;
a second pass over the fit list whitens it, merges the covariance of that in the same way
and reports its largest distance from the identity.

What is broadcast (by closure) is the mean and ``k`` eigenvectors of D numbers.

Vectors that are null, or hold null or non-finite entries, are left out; so are empty ones,
which have no component.  Vectors of different lengths are whitened by length, each among
its own.  Repeated rows and ids, and null ids, give a result each.  A component without
variance (fewer distinct vectors than dimensions) has ``whitened`` null; without any
variance ``explained`` is null too, and ``identity_error`` is taken over the components that
have some (0 if none has).  Eigenvalues of up to 1e-12 of the largest count as none.  An
eigenvector's largest entry is positive.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, written

GRID, COMPONENTS = 256, 4
_NO_VARIANCE = 1e-12


class State(NamedTuple):
    """Count, mean and centred scatter of some vectors, and their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]


def state(x: np.ndarray, sums: list[int] | None = None) -> State:
    """Of the rows of ``x``, centred before multiplying."""
    mean = x.mean(0, dtype=np.float64)
    z = x - mean
    return State(len(x), mean, z.T @ z, sums if sums is not None else exact_sums(x))


def exact_sums(x: np.ndarray) -> list[int]:
    """Whole column sums, in halves of 32 bits, which cannot overflow."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return [(int(h) << 32) + int(s) for h, s in zip(high.sum(0), low.sum(0))]


def merge(a: State, b: State) -> State:
    """The state of both sets of vectors together."""
    n, d = a.n + b.n, b.mean - a.mean
    return State(n, a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * (b.n / n)), [p + q for p, q in zip(a.sums, b.sums)])


def merge_by_length(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    return {k: merge(a[k], b[k]) if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, rows) of a list column without nulls."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths := np.diff(column.offsets.to_numpy()))
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield int(size), at, flat[(ends[at] - size)[:, None] + np.arange(size)]


def tree_state(vectors: DataFrame, shape=lambda size, x: (x, None), depth: int = 2) -> dict[int, State]:
    """The state of the only column of ``vectors`` by length of vector; ``shape`` maps a batch first (to rows and their sums)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, State] = {}
        for b in batches:
            for size, _, x in matrices(b.column(0)):
                found = merge_by_length(found, {size: state(*shape(size, x))})
        rows = [(size, s.n, s.mean.tobytes(), s.scatter.tobytes(), [str(v) for v in s.sums]) for size, s in found.items()]
        rows = rows or [(0, 0, b"", b"", [])]  # a partition without vectors takes part in the reduction too
        names = ["size", "n", "mean", "scatter", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())))], names)
        release()

    def read(row) -> dict[int, State]:
        mean = np.frombuffer(row["mean"])
        if not row["n"]:
            return {}
        return {row["size"]: State(row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)), [int(v) for v in row["sums"]])}

    states = vectors.mapInArrow(partial, "size int, n long, mean binary, scatter binary, sums array<string>").rdd.map(read)
    return states.treeReduce(merge_by_length, depth) if states.getNumPartitions() else {}


class Whitening(NamedTuple):
    """What whitens vectors of one length: their mean, and a row for each component."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows times components; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x - self.mean) @ self.axes.T / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 by row, exact."""
        most, total = max(int(x.max(initial=0)), -int(x.min(initial=0))), max(map(abs, self.sums), default=0)
        fits = len(self.sums) * most * max(most, total) < 1 << 62
        x, s = (x, np.array(self.sums, "i8")) if fits else (x.astype(object), np.array(self.sums, object))
        squares, products, n, rest = (x * x).sum(1), x @ s, self.n, sum(v * v for v in self.sums)
        return [n * n * int(q) - 2 * n * int(p) + rest for q, p in zip(squares, products)]


def grid_vectors(column: Column, grid: int = GRID) -> Column:
    """Entries as whole numbers of 1 / ``grid``; null for vectors that cannot be used."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * grid).cast("long"))
    return F.when(column.isNotNull() & (F.size(column) > 0) & F.forall(column, finite), x)


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of vector in the stored table of distinct vectors."""
    models = {}
    for size, s in tree_state(fit_list).items():
        values, axes = np.linalg.eigh(s.scatter / s.n)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components].T
        values = np.where(values > _NO_VARIANCE * max(values[0], 0), values, 0.0)
        flip = np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0
        models[size] = Whitening(s.n, s.sums, np.array([v / s.n for v in s.sums]), np.where(flip, -axes, axes), values, float(np.trace(s.scatter) / s.n))

    def shape(size: int, x: np.ndarray):
        z = np.nan_to_num(models[size].whiten(x))
        return z, [0] * z.shape[1]

    for size, s in tree_state(fit_list, shape).items():
        wanted = np.diag((models[size].values > 0).astype(float))
        models[size] = models[size]._replace(error=float(np.abs(s.scatter / s.n - wanted).max()))
    return models


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of each usable vector and component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), grid_vectors(F.col(vector_col), grid).alias("x")).filter("x is not null")
    models = fit(written(rows.select("x").distinct(), "whitening-fit"), components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, at, x in matrices(b.column(1)):
                m, k = models[size], len(models[size].values)
                z = m.whiten(x).ravel()
                column = lambda v, kind: pa.array(np.tile(v, len(at)), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(at, k))),
                        column(np.arange(1, k + 1), pa.int32()),
                        pa.array(np.full(len(z), m.n), pa.int64()),
                        pa.array([str(d) for d in m.deviations(x) for _ in range(k)], pa.string()),
                        pa.array(z, pa.float64(), mask=np.isnan(z)),
                        column(m.values / m.trace, pa.float64()) if m.trace > 0 else pa.nulls(len(z), pa.float64()),
                        pa.array(np.full(len(z), m.error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        release()

    out = rows.mapInArrow(apply, "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.expr("try_cast(deviation as decimal(38, 0))"))


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every embedding; a deviation beyond 64 bits is null."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


SQL: dict[str, str] = {}
QUERIES = {"op11_chan_whitening": op11_chan_whitening}
