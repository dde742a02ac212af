"""Moments, principal axes and least squares as columns over grouped sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the six second moments of three axes.
SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def second_moments(df: DataFrame, keys: Sequence[str], axes: Sequence[str], sample: bool = False, weight: str | None = None, centred: bool = True) -> DataFrame:
    """n and the six second moments of each group: divided by n, or n - 1 with ``sample``; optionally weighted, or not centred."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *(F.sum(w * F.col(a)).alias(f"s{i}") for i, a in enumerate(axes)), *(F.sum(w * F.col(axes[i]) * F.col(axes[j])).alias(f"p{i}{j}") for i, j in pairs))
    by = F.col("w") - 1 if sample else F.col("w")
    return sums.select(*keys, "n", *(((F.col(f"p{i}{j}") - (F.col(f"s{i}") * F.col(f"s{j}") / F.col("w") if centred else 0.0)) / by).alias(k) for (i, j), k in zip(pairs, SIX, strict=True)))


def eigenvalues(m: Sequence[Column]) -> list[Column]:
    """The eigenvalues of a symmetric 3 x 3 matrix (xx, xy, xz, yy, yz, zz), descending, in closed form."""
    xx, xy, xz, yy, yz, zz = m
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off
    p = F.sqrt(p2 / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    flat = p2 <= 1e-300
    return [F.when(flat, q).otherwise(first), F.when(flat, q).otherwise(3 * q - first - last), F.when(flat, q).otherwise(last)]


def axis_columns(m: Sequence[Column], values: Sequence[Column]) -> list[Column]:
    """The nine numbers of (A - b I)(A - c I), column by column, b and c the two smaller eigenvalues: its columns lie along the greatest one's axis."""
    xx, xy, xz, yy, yz, zz = m
    _, b, c = values
    one = [[xx - b, xy, xz], [xy, yy - b, yz], [xz, yz, zz - b]]
    two = [[xx - c, xy, xz], [xy, yy - c, yz], [xz, yz, zz - c]]
    return [one[i][0] * two[0][j] + one[i][1] * two[1][j] + one[i][2] * two[2][j] for j in range(3) for i in range(3)]


def longest_column(k: Sequence[Column]) -> list[Column]:
    """Unit vector of the longest of three columns; all zero (no direction stands out): null."""
    length = [F.sqrt(k[3 * j] * k[3 * j] + k[3 * j + 1] * k[3 * j + 1] + k[3 * j + 2] * k[3 * j + 2]) for j in range(3)]
    longest = F.greatest(*length)
    which = F.when(length[0] == longest, 0).when(length[1] == longest, 1).otherwise(2)
    return [F.when(longest > 0, F.when(which == 0, k[i]).when(which == 1, k[3 + i]).otherwise(k[6 + i]) / longest) for i in range(3)]


def anisotropy(values: Sequence[Column]) -> Column:
    """Fractional anisotropy of three eigenvalues."""
    a, b, c = values
    top = (a - b) * (a - b) + (b - c) * (b - c) + (a - c) * (a - c)
    return F.sqrt(top / (2 * (a * a + b * b + c * c)))


def regression(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """n, slope, intercept, their standard errors and adjusted R² of y on x for each group; rows with a null are left out."""
    rows = df.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    slope = F.col("c") / F.col("vx")
    rest = F.greatest(F.col("vy") - F.col("c") * F.col("c") / F.col("vx"), F.lit(0.0)) * F.col("n")
    var = rest / (F.col("n") - 2)
    r2 = 1 - rest / (F.col("vy") * F.col("n"))
    return s.where("n > 2 AND vx > 0").select(
        *keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.sqrt(var / (F.col("n") * F.col("vx"))).alias("slope_se"), F.sqrt(var * (1 / F.col("n") + F.col("mx") * F.col("mx") / (F.col("n") * F.col("vx")))).alias("intercept_se"),
        (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adjusted_r2"),
    )


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b`` (numbers of columns), n and the sums sa, saa, sab over rows where both are finite numbers: one pass for all pairs.

    Values are centred on their column's mean first. A task adds up its batches as a Gram matrix of
    the columns, nulls as zeros, so it emits a row for each pair of columns, whatever its rows.
    """
    plain = [F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows, k = df.select(*plain), len(columns)
    means = np.array([m or 0.0 for m in rows.agg(*(F.avg(f"c{i}") for i in range(k))).first()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in batch.columns], axis=1) - means
            m = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        a, b = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(v.ravel()) for v in total)], names=["a", "b", "n", "sa", "saa", "sab"])

    partial = rows.mapInArrow(run, "a long, b long, n double, sa double, saa double, sab double")
    sums = partial.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "saa", "sab")))
    return sums.withColumn("mean", F.element_at(F.array(*map(F.lit, means.tolist())), (F.col("a") + 1).cast("int")))


def all_regressions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r and the line b = slope * a + intercept, its standard errors and adjusted R², for each ordered pair of columns with more than two common rows and both varying."""
    sums = pair_sums(df, columns).where("a <> b")
    other = sums.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("sa").alias("sb"), F.col("saa").alias("sbb"), F.col("mean").alias("mean_b"))
    n = F.col("n")
    both = sums.join(other, ["a", "b"]).where("n > 2").select("a", "b", "n", (F.col("mean") + F.col("sa") / n).alias("ma"), (F.col("mean_b") + F.col("sb") / n).alias("mb"), (F.col("saa") - F.col("sa") * F.col("sa") / n).alias("vaa"), (F.col("sbb") - F.col("sb") * F.col("sb") / n).alias("vbb"), (F.col("sab") - F.col("sa") * F.col("sb") / n).alias("vab"))
    aa, bb, ab, ma = (F.col(c) for c in ("vaa", "vbb", "vab", "ma"))
    slope, rest = ab / aa, F.greatest(bb - ab * ab / aa, F.lit(0.0))
    var = rest / (n - 2)
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), (F.col(c) + 1).cast("int")).alias(c)
    return both.where("vaa > 0 AND vbb > 0").select(
        name("a"), name("b"), n.cast("long").alias("n"), (ab / F.sqrt(aa * bb)).alias("r"), slope.alias("slope"), (F.col("mb") - slope * ma).alias("intercept"),
        F.sqrt(var / aa).alias("slope_se"), F.sqrt(var * (1 / n + ma * ma / aa)).alias("intercept_se"), (1 - rest / bb * (n - 1) / (n - 2)).alias("adjusted_r2"),
    )


def through_origin(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """n and slope of y on x through the origin."""
    rows = df.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"))


def solve3(rows: Sequence[Sequence[Column]], right: Sequence[Column]) -> list[Column]:
    """A symmetric 3 x 3 system by Cramer's rule; null if it has no single solution."""

    def det(m: Sequence[Sequence[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = det(rows)
    return [F.when(whole != 0, det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / whole) for k in range(3)]


def quadratic(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """n and c0, c1, c2 of y = c0 + c1 x + c2 x² by least squares for each group."""
    rows = df.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.pow("x", F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)), *(F.sum(F.pow("x", F.lit(float(k))) * F.col("y")).alias(f"t{k}") for k in range(3)))
    s = [F.col("n").cast("double"), *(F.col(f"s{k}") for k in range(1, 5))]
    c = solve3([[s[i + j] for j in range(3)] for i in range(3)], [F.col(f"t{k}") for k in range(3)])
    return sums.where("n >= 3").select(*keys, "n", *(v.alias(f"c{k}") for k, v in enumerate(c)))
