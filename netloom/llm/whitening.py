"""Embedding whitening from a covariance by polarisation.

Vectors become whole numbers x = floor(scale * c). The fit list has each distinct x once. Its exact
sums S give whole centres m near the means; of z = x - m the squares are summed for each dimension,
and the squares of z_i + z_j for each pair of dimensions. With T = S - n * m, n times such a sum less
the square of its part of T is n * n times the variance of that dimension or pair sum, so

    2 * cov(i, j) = var(i + j) - var(i) - var(j)

holds in whole numbers; only the quotient by n * n is rounded, once. Each task adds its rows' squares
and Spark adds the tasks', as decimals in two parts of 64 bits. The d * (d + 1) / 2 totals (d: the
dimension, no rows of data) are assembled on the driver for eigh.

Defined cases: vectors that are null or hold null or non-finite components have no rows; shorter
vectors are filled with zeros; repeated rows and null ids are whitened like others and count once
in the fit list; a component whose variance is zero to within rounding has a null ``whitened``, and
explains 0 (null where no component varies); ``deviation`` is null where it doesn't fit in a long (``deviation_exact`` is a
decimal of 38 digits); an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .vectors import LOT, dimension, largest, matrix, whole

_PART = 1 << 64
_SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"
_WIDE = pa.decimal128(38, 0)


def _parts(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, LOT):
            part = batch.slice(first, LOT)
            yield part, matrix(part.column("x"), dim)


def _fits(bound: int) -> type:
    """The numbers that hold whole values up to ``bound`` exactly."""
    return np.int64 if bound < 1 << 63 else object


def _emit(sums: dict[tuple[int, int], int]) -> pa.RecordBatch:
    """Totals as rows; floor division keeps the low part positive."""
    i, j = ([k[at] for k in sums] for at in (0, 1))
    high, low = ([Decimal(f(v)) for v in sums.values()] for f in (lambda v: v // _PART, lambda v: v % _PART))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, _WIDE), pa.array(low, _WIDE)], names=["i", "j", "high", "low"])


def _total(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j): d * (d + 1) / 2 numbers at most."""
    found = rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): int(r["high"]) * _PART + int(r["low"]) for r in found}


def dimension_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dim, 0
        for part, x in _parts(batches, dim):
            n += part.num_rows
            for i, s in enumerate(x.astype(_fits(largest(x) * LOT)).sum(axis=0).tolist()):
                sums[i] += s
        yield _emit({(-1, -1): n} | {(i, i): s for i, s in enumerate(sums)})

    found = _total(fit.select("x").mapInArrow(run, _SUMS))
    return found.get((-1, -1), 0), [found.get((i, i), 0) for i in range(dim)]


def squares(fit: DataFrame, centres: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums over ``fit`` of z_i ** 2 (i, i) and (z_i + z_j) ** 2 (i < j), for z = x - centres."""
    dim = len(centres)
    spread = max(map(abs, centres), default=0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for _, x in _parts(batches, dim):
            kind = _fits((2 * (largest(x) + spread)) ** 2 * LOT)
            z = x.astype(kind) - np.array(centres, kind)
            for i in range(dim):
                both = z[:, i:] + z[:, i : i + 1]
                both[:, 0] = z[:, i]
                for j, s in enumerate((both * both).sum(axis=0).tolist(), i):
                    sums[i, j] = sums.get((i, j), 0) + s
        yield _emit(sums)

    return _total(fit.select("x").mapInArrow(run, _SUMS))


def covariance(n: int, rest: list[int], sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances, divisor n; ``rest`` is the sum of z in each dimension."""
    dim = len(rest)
    variance = {(i, j): n * sums[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for i in range(dim) for j in range(i, dim)}
    found = np.zeros((dim, dim))
    for (i, j), v in variance.items():
        found[i, j] = found[j, i] = (v if i == j else (v - variance[i, i] - variance[j, j]) // 2) / (n * n)
    return found


class Whitening:
    """A fitted whitening: n, sums and covariance of the fit list, components (rows) and their eigenvalues, falling."""

    def __init__(self, fit: DataFrame, components: int) -> None:
        self.dim = dimension(fit)
        self.n, self.sums = dimension_sums(fit, self.dim)
        self.centres = [(2 * s + self.n) // (2 * self.n) if self.n else 0 for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.centres, strict=True)]
        self.covariance = covariance(self.n, self.rest, squares(fit, self.centres)) if self.n else np.zeros((self.dim, self.dim))
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.components = values[order], vectors.T[order]
        largest_at = np.abs(self.components).argmax(axis=1) if self.dim else []
        self.components = self.components * np.where(self.components[np.arange(len(order)), largest_at] < 0, -1.0, 1.0)[:, None]
        self.trace = float(np.trace(self.covariance))
        self.varies = self.values > self.trace * max(1, self.dim) * 2.0**-50
        self.explained = [max(0.0, v) / self.trace if self.trace > 0 else None for v in self.values.tolist()]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        kind = _fits(largest(x) + max(map(abs, self.centres), default=0))
        return (x.astype(kind) - np.array(self.centres, kind)).astype(np.float64) - np.array([t / self.n for t in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the components that vary; NaN for the others."""
        scaled = np.where(self.varies, np.sqrt(np.where(self.varies, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.components.T / scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - S) ** 2."""
        top = self.n * (largest(x) + max(map(abs, self.centres), default=0)) + max(map(abs, self.rest), default=0)
        kind = _fits(top * top * max(1, self.dim))
        y = (x.astype(kind) - np.array(self.centres, kind)) * self.n - np.array(self.rest, kind)
        return (y * y).sum(axis=1).tolist()

    def identity_error(self, fit: DataFrame) -> float | None:
        """The largest absolute entry of the whitened values' covariance over the fit list, less the identity; null if none varies."""
        k, dim = len(self.values), self.dim

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, products = np.zeros(k), np.zeros((k, k))
            for _, x in _parts(batches, dim):
                w = self.project(x)
                sums, products = sums + w.sum(axis=0), products + w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()]), pa.array([products.ravel().tolist()])], names=["sums", "products"])

        if not self.n or not self.varies.any():
            return None
        partial = fit.select("x").mapInArrow(run, "sums array<double>, products array<double>")
        add = lambda c: partial.select(F.posexplode(c).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at")
        mean = np.array([r["v"] for r in add("sums").collect()]) / self.n
        found = np.array([r["v"] for r in add("products").collect()]).reshape(k, k) / self.n - np.outer(mean, mean)
        error = np.abs(found - np.eye(k))
        return float(error[np.ix_(self.varies, self.varies)].max())


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``vectors`` by component: component, n, deviation, whitened, explained, identity_error, deviation_exact. carry: the columns to keep (all)."""
    outputs = ["component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    carried = [c for c in (vectors.columns if carry is None else carry) if c not in outputs]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    rows = vectors.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), whole(F.col(f"`{vector_col}`"), scale).alias("x")).where("x IS NOT NULL")
    fit = written(rows.select("x").distinct())
    model = Whitening(fit, components)
    error = model.identity_error(fit)
    fields = [rows.schema[n] for n in renamed.values()]
    schema = T.StructType([*fields, T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, model.dim):
            exact = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            w = [[None if v != v else v for v in r] for r in model.project(x).tolist()]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(exact, _WIDE), pa.array(w, pa.list_(pa.float64()))], names=schema.names)

    explained = F.array(*(F.lit(e).cast("double") for e in model.explained)) if model.explained else F.array().cast("array<double>")
    out = rows.mapInArrow(run, schema).select("*", F.posexplode("w").alias("at", "whitened"))
    long = F.when(F.col("deviation_exact") <= (1 << 63) - 1, F.col("deviation_exact").cast("long"))
    return out.select(
        *(F.col(n).alias(c) for c, n in renamed.items()), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), long.alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
