"""Whitening of embeddings by two passes over all vectors.

The first pass sums whole numbers, so that the mean is exact; the second sums outer products of the
centred vectors, a GEMM for each Arrow batch, and merges the tasks' matrices by ``treeAggregate``. The
covariance is decomposed on the driver by LAPACK's symmetric solver (its size is the square of the
dimension, whatever the number of rows), and the projection is broadcast. A third pass measures how far
the covariance of the whitened vectors is from the identity.

An entry c counts as the whole number x = floor(``SCALE`` * c) + ``OFFSET``. With n rows and sums S, the
quotient q and remainder b of S by n, x - S/n is (x - q) - b/n: a whole number less a fraction below one,
so centring loses nothing to large means.

Defined cases: a row takes no part if its vector is null or empty, holds a null or non-finite entry, an
entry beyond ``MOST`` in size (no exact double) or is not of the commonest length (of two as common, the
longer); a repeated row counts again and gets its own results; a null ``vec_id`` is carried along; other
columns are left out; an empty table gives an empty result. A component without variance (constant or
dependent dimensions, a single row) has null as ``whitened`` and 0 as ``explained``, and the identity is
measured over the others (0 if there is none). ``deviation`` is null beyond 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import vectors
from colloquy.session import forget, materialize

SCALE, OFFSET = 64, 1_000_000
#: The largest size of an entry: 2 ** 52 when scaled.
MOST = float(2**46)
#: Tasks from which partial matrices are merged over one more level.
DEEP = 10_000
#: Bits by which whole numbers are split, so that sums of either half stay in 64 bits.
HALF = 26


def whole(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(vectors.matrix(column, width) * SCALE).astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Mean:
    """Number of rows and exact sums, one for each dimension."""

    n: int
    sums: tuple[int, ...]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole quotients and remainders of the sums by n."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        q, b = self.split()
        return (x - q).astype(np.float64) - b / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S) ** 2 of every row, exactly, from n (x - q) - b."""
        q, b = self.split()
        a, b = x - q, b
        big = int(np.abs(a).max(initial=0))
        if max(big * big, big * self.n, self.n * self.n) * len(b) >= 1 << 63:
            a, b = a.astype(object), b.astype(object)
        squares, products, rest = (a * a).sum(1), (a * b).sum(1), int((b * b).sum())
        return [self.n * self.n * int(s) - 2 * self.n * int(p) + rest for s, p in zip(squares, products, strict=True)]


def usable(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "embedding").where(vectors.finite(F.col("embedding"), MOST))


def mean(rows: DataFrame) -> Mean:
    """First pass, over ``usable`` rows: sums of the vectors of the commonest length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                x = whole(column.filter(pa.array(sizes == width)), width)
                halves = np.stack([(x >> HALF).sum(0), (x & ((1 << HALF) - 1)).sum(0)])
                n, sums = found.get(width, (0, 0))
                found[width] = n + len(x), sums + halves
        for width, (n, (high, low)) in found.items():
            place = pa.array(np.arange(width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, width, np.int32)), place, pa.array(np.full(width, n)), pa.array(high), pa.array(low)], ["width", "i", "n", "high", "low"])

    parts = rows.select("embedding").mapInArrow(add, "width int, i int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    sums = materialize(parts.groupBy("width", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low")), "sums")
    commonest = sums.where("i = 0").orderBy(F.desc("n"), F.desc("width")).first()
    got = [] if commonest is None else sums.where(F.col("width") == commonest.width).orderBy("i").collect()
    forget(sums)
    return Mean(got[0].n if got else 0, tuple((int(r.high) << HALF) + int(r.low) for r in got))


def _gram(rows: DataFrame, width: int, derive: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of what ``derive`` makes of each batch (rows of ``width`` doubles)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = derive(batch.column(0))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = rows.select("embedding").mapInArrow(add, "part binary").rdd
    depth = 2 if parts.getNumPartitions() < DEEP else 3
    return parts.treeAggregate(np.zeros((width, width)), lambda a, row: a + np.frombuffer(row.part).reshape(width, width), np.add, depth)


@dataclass(frozen=True)
class Whitening:
    """Mean, the leading components (columns, null variance left out) and each one's share of the variance."""

    mean: Mean
    components: np.ndarray
    variances: np.ndarray
    explained: tuple[float, ...]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ (self.components / np.sqrt(self.variances))


def decompose(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """Unit eigenvectors by falling eigenvalue, those eigenvalues above rounding, and shares of the trace."""
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:most], found[:, ::-1][:, :most]
    floor = max(values[0], 0) * len(covariance) * np.finfo(float).eps
    held = int((values > floor).sum())
    largest = found[np.abs(found).argmax(0), np.arange(found.shape[1])]
    trace = np.trace(covariance)
    shares = tuple(float(v / trace) if i < held else 0.0 for i, v in enumerate(values))
    return (found * np.sign(largest))[:, :held], values[:held], shares


def fit(rows: DataFrame, components: int = 32) -> Whitening:
    """Both passes over ``usable`` rows of one length, whose mean is given by ``mean``."""
    of = mean(rows)
    width = len(of.sums)
    if not of.n:
        return Whitening(of, np.zeros((0, 0)), np.zeros(0), ())
    total = _gram(alike(rows, of), width, lambda column: of.centred(whole(column, width)))
    return Whitening(of, *decompose(total / of.n, components))


def alike(rows: DataFrame, of: Mean) -> DataFrame:
    return rows.where(F.size("embedding") == len(of.sums))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened vectors' covariance less the identity, over all rows."""
    held, width, n = len(model.variances), len(model.mean.sums), model.mean.n
    if not held:
        return 0.0

    def derive(column: pa.Array) -> np.ndarray:
        w = model.apply(whole(column, width))
        return np.hstack([w, np.ones((len(w), 1))])

    total = _gram(alike(rows, model.mean), held + 1, derive) / n
    centre = total[:held, held]
    return float(np.abs(total[:held, :held] - np.outer(centre, centre) - np.eye(held)).max())


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` (decimal) and ``whitened`` (an array, null where a component has no variance)."""
    spark, width, missing = rows.sparkSession, len(model.mean.sums), len(model.explained) - len(model.variances)
    sent = spark.sparkContext.broadcast(model)  # dimension times components

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            x = whole(batch.column(1), width)
            w = of.apply(x)
            values = np.hstack([w, np.zeros((len(w), missing))])
            absent = np.hstack([np.zeros(w.shape, bool), np.ones((len(w), missing), bool)])
            offsets = np.arange(len(w) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), mask=absent.ravel()))
            exact = [Decimal(v) if v < 10**38 else None for v in of.mean.deviations(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return alike(rows, model.mean).mapInArrow(apply, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def whiten(rows: DataFrame, components: int = 32) -> DataFrame:
    """One row for each usable row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``."""
    rows = usable(rows)
    model = fit(rows, components)
    error = identity_error(rows, model)
    long = project(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(s) for s in model.explained]).cast("array<double>")
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.mean.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
