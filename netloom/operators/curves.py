"""Curves: tables of points (curve, x, y). Segments between neighbouring points carry all interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import finite


def segments(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """x0, y0, x1, y1 of neighbouring points (x unique: the least y of equal x), and ``final`` for a curve's last segment."""
    unique = points.where(finite(F.col(x)) & finite(F.col(y))).groupBy(*keys, F.col(x).cast("double").alias("x0")).agg(F.min(F.col(y).cast("double")).alias("y0"))
    order = Window.partitionBy(*keys).orderBy("x0") if keys else Window.partitionBy(F.lit(0)).orderBy("x0")
    both = unique.withColumns({"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order), "final": F.lead("x0", 2).over(order).isNull()})
    return both.where("x1 IS NOT NULL")


def on_line(x: Column) -> Column:
    return F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))


def resample(points: DataFrame, keys: Sequence[str], x: str, y: str, start: float, step: float, n: int) -> DataFrame:
    """keys, i, x, y of each curve at start + i step, 0 <= i < n, by linear interpolation, nothing outside the curve.

    Each segment makes its own grid points, so no range join is needed.
    """
    seg = segments(points, keys, x, y)
    first = F.greatest(F.ceil((F.col("x0") - start) / step), F.lit(0))
    end = (F.col("x1") - start) / step
    last = F.least(F.when(F.col("final"), F.floor(end)).otherwise(F.ceil(end) - 1), F.lit(n - 1))
    seg = seg.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    at = F.lit(start) + F.col("i") * step
    return seg.select(*keys, "i", at.alias("x"), on_line(at).alias("y"))


def mean_curve(sampled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean and population std of resampled curves at each grid point."""
    return sampled.groupBy(*keys, "i", "x").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"))


def default_grid(points: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """start, step and n of a grid from the medians of the curves' least x, greatest x and mean step: one row."""
    each = points.where(finite(F.col(x))).groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"), F.count_distinct(x).alias("k")).where("k > 1")
    each = each.withColumn("s", (F.col("b") - F.col("a")) / (F.col("k") - 1))
    out = each.agg(F.median("a").alias("start"), F.median("b").alias("stop"), F.median("s").alias("step"))
    return out.select("start", "step", (F.ceil((F.col("stop") - F.col("start")) / F.col("step")) + 1).alias("n"))


def cumulative(points: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "total") -> DataFrame:
    """Running sum of ``value`` at each distinct ``order``."""
    sums = points.groupBy(*keys, order).agg(F.sum(value).alias("__s"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn(name, F.sum("__s").over(w)).drop("__s")


def zero_crossings(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """x where y changes sign, by linear interpolation, and where it is zero."""
    exact = points.where(F.col(y) == 0).select(*keys, F.col(x).cast("double").alias("x"))
    between = segments(points, keys, x, y).where("y0 * y1 < 0").select(*keys, (F.col("x0") - F.col("y0") * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    return exact.unionByName(between)


def steepest(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """x of the greatest central difference of each curve (the least x of equal ones)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(x)
    slope = (F.lead(y).over(w) - F.lag(y).over(w)) / (F.lead(x).over(w) - F.lag(x).over(w))
    rows = points.withColumn("slope", slope).where("slope IS NOT NULL")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(x, "slope"), F.struct("slope", -F.col(x))).alias("best")).select(*keys, F.col(f"best.{x}").alias(x), "best.slope")


def local_maxima(points: DataFrame, keys: Sequence[str], x: str, y: str, width: int) -> DataFrame:
    """Points at least as high as all of the ``width`` points around (even widths reach one further back)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(x).rowsBetween(-(width // 2), (width - 1) // 2)
    return points.withColumn("__m", F.max(y).over(w)).where(F.col(y) >= F.col("__m")).drop("__m")


def rebin(bins: DataFrame, keys: Sequence[str], start: float, step: float, n: int) -> DataFrame:
    """Histograms (keys, low, high, pdf) on n new bins: area up to each new edge by interpolation, differences, floor at 0."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("low")
    area = F.sum(F.col("pdf") * (F.col("high") - F.col("low"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    top = bins.withColumn("area", area).select(*keys, F.col("high").alias("x"), F.col("area").alias("y"))
    low = bins.groupBy(*keys).agg(F.min("low").alias("x")).withColumn("y", F.lit(0.0))
    knots = low.unionByName(top)
    grid = resample(knots, keys, "x", "y", start, step, n + 1)
    ends = knots.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max("y").alias("all"))
    edges = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))).withColumn("x", F.lit(start) + F.col("i") * step)
    full = edges.join(grid.drop("x"), [*keys, "i"], "left").withColumn("y", F.coalesce("y", F.when(F.col("x") < F.col("a"), 0.0).otherwise(F.col("all"))))
    by_edge = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("i")
    full = full.withColumn("pdf", F.greatest((F.lead("y").over(by_edge) - F.col("y")) / step, F.lit(0.0)))
    return full.where(F.col("i") < n).select(*keys, F.col("i").alias("bin"), "pdf")


def trim(bins: DataFrame, low: float, high: float) -> DataFrame:
    """Bins (bin, probability) between the last with cdf <= low and the first with cdf >= high."""
    w = Window.partitionBy(F.lit(0))
    cdf = bins.withColumn("cdf", F.sum("probability").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.max(F.when(F.col("cdf") <= low, F.col("bin"))).over(w), F.min(F.when(F.col("cdf") >= high, F.col("bin"))).over(w)
    return cdf.withColumn("__a", F.coalesce(first, F.lit(0))).withColumn("__b", last).where(F.col("bin").between(F.col("__a"), F.coalesce(F.col("__b"), F.col("bin")))).drop("__a", "__b")


def knee(bins: DataFrame) -> DataFrame:
    """The bin of a histogram's tail (bin, mid, count) farthest below the line from its peak to its last filled bin: one row."""
    w = Window.partitionBy(F.lit(0))
    filled = bins.where("count > 0").withColumn("peak", F.max_by(F.struct("bin", "mid", "count"), F.struct("count", -F.col("bin"))).over(w)).withColumn("end", F.max_by(F.struct("bin", "mid", "count"), "bin").over(w))
    dx, dy = F.col("end.mid") - F.col("peak.mid"), F.col("end.count") - F.col("peak.count")
    distance = F.abs(dy * (F.col("mid") - F.col("peak.mid")) - dx * (F.col("count") - F.col("peak.count"))) / F.sqrt(dx * dx + dy * dy)
    return filled.where(F.col("bin") >= F.col("peak.bin")).withColumn("distance", distance).agg(F.max_by(F.struct("bin", "mid", "distance"), F.struct("distance", -F.col("bin"))).alias("b")).select("b.*")


def first_reach(points: DataFrame, keys: Sequence[str], x: str, y: str, levels: Sequence[float]) -> DataFrame:
    """x at which y first reaches each level, by interpolation over ascending x."""
    seg = segments(points, keys, x, y).withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    hit = seg.where("y0 < level AND y1 >= level").withColumn("x", F.col("x0") + (F.col("level") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    return hit.groupBy(*keys, "level").agg(F.min("x").alias("x"))
