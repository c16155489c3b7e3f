"""Embedding whitening: exact integer sums, a second pass of centred outer products, eigenvectors, one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm.common import dropped, slices, written

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components of a row, and vectors that one matrix product takes.
COMPONENTS, ROWS = 16, 2000
#: Scaled entries stay under this, so that differences of two fit a long; an entry beyond it counts as not finite.
LIMIT = 1 << 61
#: A component whose eigenvalue is under this share of the largest one has no variance but rounding.
FLAT = 1e-12


@dataclass
class Axes:
    """A fit over ``n`` vectors of one length: ``near`` (long) and ``rest`` (times n) make up the mean, exactly; columns of
    ``to`` whiten; ``share`` is each component's part of the trace."""

    n: int
    near: np.ndarray
    rest: np.ndarray
    to: np.ndarray
    share: np.ndarray
    error: float = 0.0

    @classmethod
    def of(cls, n: int, sums: np.ndarray, products: np.ndarray, components: int) -> Axes:
        near, rest = split_mean(n, sums)
        cov = products / n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.arange(len(values))[::-1][:components]
        order = order[values[order] > FLAT * max(values[-1], 0)] if len(values) else order
        values, vectors = values[order], vectors[:, order]
        lead = np.abs(vectors).argmax(axis=0) if vectors.size else order
        vectors = vectors * np.where(vectors[lead, np.arange(len(order))] < 0, -1.0, 1.0)
        return cls(n, near, rest, vectors / np.sqrt(values), values / max(np.trace(cov), np.finfo(float).tiny))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.near, self.rest)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.to

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where it is no long."""
        step = x - self.near
        small = (float(self.n) * np.abs(step.astype(float)).max(axis=1, initial=0) + self.n) ** 2 * x.shape[1] < 2.0**62
        out: list[int | None] = [None] * len(x)
        y = self.n * step[small] - self.rest.astype(np.int64)
        for i, v in zip(np.flatnonzero(small), (y * y).sum(axis=1), strict=True):
            out[i] = int(v)
        for i in np.flatnonzero(~small):
            v = sum((self.n * int(s) - int(r)) ** 2 for s, r in zip(step[i], self.rest, strict=True))
            out[i] = v if v < 1 << 63 else None
        return out


def split_mean(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S = n near + rest with ``near`` the integers closest to the mean; ``sums`` holds Python integers."""
    near = [(2 * int(s) + n) // (2 * n) for s in sums]
    return np.array(near, np.int64), np.array([int(s) - n * m for s, m in zip(sums, near, strict=True)], object)


def centred(x: np.ndarray, n: int, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - near).astype(np.float64) - rest.astype(np.float64) / n


def by_length(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal length together: (rows, their vectors as a matrix of longs)."""
    for part in slices(batches, ROWS):
        lengths = part.column(column).value_lengths().to_numpy()
        for d in np.unique(lengths):
            rows = part if (lengths == d).all() else part.filter(pa.array(lengths == d))
            yield rows, rows.column(column).flatten().to_numpy().reshape(rows.num_rows, d)


def merged(vectors: DataFrame, column: str, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Arrays that ``of`` makes of each matrix of vectors, added up for each length: within tasks, then by a tree of tasks."""

    def sums(batches):
        found: dict[int, np.ndarray] = {}
        for rows, x in by_length(batches, column):
            d = x.shape[1]
            found[d] = found[d] + of(x) if d in found else of(x)
        for d, a in found.items():
            flat = [str(v).encode() for v in a.ravel()] if a.dtype == object else [a.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([flat], pa.list_(pa.binary()))], ["d", "a"])

    def add(a: dict, b: dict) -> dict:
        return a | {d: a[d] + x if d in a else x for d, x in b.items()}

    def read(r) -> dict:
        flat = r["a"]
        return {r["d"]: np.frombuffer(flat[0], np.float64) if len(flat) == 1 else np.array([int(v) for v in flat], object)}

    parts: RDD = vectors.mapInArrow(sums, "d long, a array<binary>").rdd.map(read)
    return parts.treeAggregate({}, add, add)


def integer_sums(x: np.ndarray) -> np.ndarray:
    """Number of rows, a spare, and column sums as Python integers: halves of longs are summed apart and can't overflow."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return np.array([len(x), 0, *((int(h) << 32) + int(w) for h, w in zip(high, low, strict=True))], object)


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> dict[int, Axes]:
    """Axes by length of the vectors of longs in ``column``, each row being one vector of the fit list.

    Three passes: exact sums; outer products of centred vectors (a matrix product for some thousand of them); and the
    whitened vectors' covariance, for ``error``. The driver gets (d, d) matrices only, for each length d.
    """
    spark = vectors.sparkSession
    counts = {d: (int(a[0]), a[2:]) for d, a in merged(vectors, column, integer_sums).items()}
    means = spark.sparkContext.broadcast({d: (n, *split_mean(n, s)) for d, (n, s) in counts.items()})

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x, *means.value[x.shape[1]])
        return (c.T @ c).ravel()

    products = merged(vectors, column, outer)
    axes = {d: Axes.of(n, s, products[d].reshape(d, d), components) for d, (n, s) in counts.items()}
    shared = spark.sparkContext.broadcast(axes)

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.hstack([np.ones((len(x), 1)), shared.value[x.shape[1]].whitened(x)])
        return (w.T @ w).ravel()

    for d, m in merged(vectors, column, moments).items():
        k = len(axes[d].share)
        m = m.reshape(k + 1, k + 1) / m[0]
        axes[d].error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0))
    means.unpersist()
    shared.unpersist()
    return axes


def whitened(rows: DataFrame, axes: dict[int, Axes], key: str, column: str = "x") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row and component. The axes, at
    most (d, components) numbers a length, are broadcast; nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(axes)
    kind = rows.schema[key].dataType.simpleString()

    def project(batches):
        for part, x in by_length(batches, column):
            a = shared.value[x.shape[1]]
            k = len(a.share)
            w = a.whitened(x)
            each = lambda v: np.repeat(np.arange(len(x)), k) if v is None else np.tile(v, len(x))
            at = each(None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key).take(pa.array(at)),
                    pa.array(each(np.arange(1, k + 1)), pa.int32()),
                    pa.array(np.full(len(at), a.n, np.int64)),
                    pa.array(a.deviation(x), pa.int64()).take(pa.array(at)),
                    pa.array(w.ravel()),
                    pa.array(each(a.share)),
                    pa.array(np.full(len(at), a.error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(key, column).mapInArrow(project, f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def scaled(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, x) of rows whose vector and all of whose entries are finite; x = floor(64 entry) + 1000000 as longs."""
    step = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / SCALE))
    return rows.where(F.coalesce(fine, F.lit(False))).select(key, F.transform(step, lambda c: c.cast("long") + OFFSET).alias("x"))


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened components of each row of ``rows`` (key, column: array of numbers).

    Rows whose vector is null, or holds an entry that is null, not finite or beyond 2^55, are left out. The fit list is
    each distinct scaled vector once, so that copies, however many, count once there and are all returned. Vectors of
    different lengths are fitted apart; empty ones have no components. Components without variance (a single vector, or
    dimensions that depend on others) are not returned; explained shares are of the whole trace. A component's sign is
    that which makes its largest entry positive. A null key stays null; other columns are not read; an empty table
    gives an empty result. ``deviation`` is null where it exceeds a long.
    """
    x = scaled(rows, key, column)
    distinct = written(x.select("x").distinct(), "vectors")
    axes = fit(distinct, "x", components)
    dropped(distinct)
    return whitened(x, axes, key)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row left and component; see
    ``whiten``. Last digits of sums of products may differ between runs, as the tree adds them in any order."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
