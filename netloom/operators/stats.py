"""Grouped statistics: order statistics, histograms, binned measures.

Order statistics come from counts of distinct values, which combine before the shuffle; nulls
and non-finite values are dropped first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the full percentile record and of the nearest-rank one (fixed values).
PERCENTILES = (0, 0.1, 1, 2.5, 5, 10, 25, 50, 75, 90, 95, 97.5, 99, 99.9, 100)
NEAREST = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def finite(value: Column) -> Column:
    value = value.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


#: Parts by value that the distinct values of a group are ranked in.
PARTS = 128


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Whether two sides agree in all keys, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ranks ``first`` to ``last`` and the group's ``n``.

    A group's values are cut into PARTS by approximate percentiles of the distinct ones; ranks are
    exact running counts within a part, plus the counts of the parts below it. So a group, even
    the only one, is many windows.
    """
    counts = df.where(finite(F.col(value))).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("__cuts"))
    cut = counts.alias("a").join(cuts.alias("b"), same_keys("a", "b", keys)) if keys else counts.crossJoin(F.broadcast(cuts)).alias("a")  # without keys: one row
    parted = cut.select(*(F.col(f"a.{k}") for k in keys), "v", "c", F.size(F.filter("__cuts", lambda x: x < F.col("v"))).alias("__part"))
    sums = parted.groupBy(*keys, "__part").agg(F.sum("c").alias("__c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most PARTS rows a group
    below = F.coalesce(F.sum("__c").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "__part", below.alias("__below"), F.sum("__c").over(group).alias("n"))
    within = F.sum("c").over(Window.partitionBy(*keys, "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    both = parted.withColumn("__within", within).alias("a").join(sums.alias("b"), same_keys("a", "b", [*keys, "__part"]))
    last = F.col("__below") + F.col("__within")
    return both.select(*(F.col(f"a.{k}") for k in keys), "v", "c", last.alias("last"), (last - F.col("c") + 1).alias("first"), "n")


def _pick(rank: Column) -> Column:
    return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))


def midpoint_percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = PERCENTILES) -> DataFrame:
    """One row a group and level: the i-th of n sorted values stands at 100 (i - 1/2) / n, linear between, clamped."""
    ranked, aggs = _ranked(df, keys, value), [F.max("n").alias("n")]
    at = [F.least(F.greatest(F.col("n") * (p / 100) + 0.5, F.lit(1.0)), F.col("n").cast("double")) for p in levels]
    for i, h in enumerate(at):
        aggs += [_pick(F.floor(h)).alias(f"a{i}"), _pick(F.ceil(h)).alias(f"b{i}")]
    wide = ranked.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(float(p)).alias("level"), (F.col(f"a{i}") + (h - F.floor(h)) * (F.col(f"b{i}") - F.col(f"a{i}"))).alias("percentile")) for i, (p, h) in enumerate(zip(levels, at, strict=True))]
    return wide.select(*keys, F.inline(F.array(*rows)))


def nearest_percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = NEAREST) -> DataFrame:
    """One row a group with q0, q1, …: element ceil(n p) of the sorted values."""
    return _ranked(df, keys, value).groupBy(*keys).agg(*(_pick(F.greatest(F.ceil(F.round(F.col("n") * p, 9)), F.lit(1))).alias(f"q{i}") for i, p in enumerate(levels)))


def basic_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, total, mean, median, population std, least, most and range of the finite values of each group."""
    v = F.col(value).cast("double")
    plain = df.where(finite(F.col(value))).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    middle = midpoint_percentiles(df, keys, value, (50,)).select(*keys, F.col("percentile").alias("median"))
    joined = plain.join(middle, list(keys)) if keys else plain.crossJoin(middle)  # without keys: one row each
    return joined.withColumn("range", F.col("most") - F.col("least"))


def bin_of(value: Column, edges: Sequence[float], closed: bool = True) -> Column:
    """Number (from 0) of the bin that holds a value: left-closed, the last one closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        below = (value <= edges[i + 1]) if closed and i == len(edges) - 2 else (value < edges[i + 1])
        out = F.when((value >= edges[i]) & below, F.lit(i)).otherwise(out)
    return F.when(~F.isnan(value.cast("double")), out)


def bins(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """A row for each bin: bin, low, high."""
    return df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """All bins with count, probability (of all finite values, also those outside), pdf, cdf and mid."""
    kept = df.where(finite(F.col(value))).select(bin_of(F.col(value), edges).alias("bin"))
    counts = kept.groupBy("bin").agg(F.count("*").alias("count"))
    total = counts.groupBy().agg(F.sum("count").alias("total"))
    full = bins(df, edges).join(counts, "bin", "left").crossJoin(F.broadcast(total))  # one row
    p = F.coalesce(F.col("count"), F.lit(0)) / F.col("total")
    running = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return full.select("bin", ((F.col("low") + F.col("high")) / 2).alias("mid"), F.coalesce("count", F.lit(0)).alias("count"), p.alias("probability"), (p / (F.col("high") - F.col("low"))).alias("pdf"), F.sum(p).over(running).alias("cdf"))


def automatic_edges(df: DataFrame, value: str) -> list[float]:
    """Edges of Scott's width, 3.5 std n^(-1/3), from one aggregation."""
    v = F.col(value).cast("double")
    n, std, low, high = df.where(finite(v)).agg(F.count("*"), F.stddev_samp(v), F.min(v), F.max(v)).first()
    if not n or not std:
        return [low or 0.0, (low or 0.0) + 1]
    width = 3.5 * std * n ** (-1 / 3)
    k = max(1, -int(-(high - low) // width))
    return [low + i * (high - low) / k for i in range(k)] + [high]


def binned_statistics(df: DataFrame, x: str, y: str, edges: Sequence[float], levels: Sequence[float] = NEAREST) -> DataFrame:
    """Per bin of x: n, mean, sample std, least, most and nearest-rank percentiles of y; empty bins are null."""
    kept = df.where(finite(F.col(x)) & finite(F.col(y))).select(bin_of(F.col(x), edges).alias("bin"), F.col(y).cast("double").alias("y")).where("bin IS NOT NULL")
    plain = kept.groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min("y").alias("least"), F.max("y").alias("most"))
    out = bins(df, edges).join(plain, "bin", "left").join(nearest_percentiles(kept, ["bin"], "y", levels), "bin", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def joint_histogram(df: DataFrame, x: str, y: str, ex: Sequence[float], ey: Sequence[float]) -> DataFrame:
    """Counts of the occupied cells of two edge lists, bin_x and bin_y."""
    return df.select(bin_of(F.col(x), ex).alias("bin_x"), bin_of(F.col(y), ey).alias("bin_y")).where("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy("bin_x", "bin_y").agg(F.count("*").alias("count"))


def mutual_information(df: DataFrame, x: str, y: str, ex: Sequence[float], ey: Sequence[float]) -> DataFrame:
    """Bits shared by two binned columns: one row."""
    cells = joint_histogram(df, x, y, ex, ey)
    p = F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))
    cells = cells.withColumn("p", p)
    px, py = F.sum("p").over(Window.partitionBy("bin_x")), F.sum("p").over(Window.partitionBy("bin_y"))
    return cells.withColumn("t", F.col("p") * F.log2(F.col("p") / (px * py))).agg(F.sum("t").alias("bits"))


def interval_rows(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Rows whose finite value lies between two midpoint percentiles of its group."""
    limits = midpoint_percentiles(df, keys, value, (low, high)).groupBy(*keys).agg(F.min(F.when(F.col("level") == low, F.col("percentile"))).alias("__low"), F.max(F.when(F.col("level") == high, F.col("percentile"))).alias("__high"))
    joined = df.join(limits, list(keys)) if keys else df.crossJoin(F.broadcast(limits))  # one row
    return joined.where(finite(F.col(value)) & F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def outlier_flags(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.5) -> DataFrame:
    """``df`` with low and high, width quartile ranges beyond the quartiles, and outlier."""
    q = midpoint_percentiles(df, keys, value, (25, 75)).groupBy(*keys).agg(F.max(F.when(F.col("level") == 25, F.col("percentile"))).alias("__a"), F.max(F.when(F.col("level") == 75, F.col("percentile"))).alias("__b"))
    spread = (F.col("__b") - F.col("__a")) * width
    q = q.select(*keys, (F.col("__a") - spread).alias("low"), (F.col("__b") + spread).alias("high"))
    joined = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))  # one row
    return joined.withColumn("outlier", ~F.col(value).between(F.col("low"), F.col("high")))


def rank_slice(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], low: float, high: float) -> DataFrame:
    """Rows of ranks round(n low / 100), at least 1, to round(n high / 100) of each group.

    Ranks come from counts of distinct values. Only rows at the first and at the last value are put
    in order, among themselves, so no group is one task's.
    """
    least, most = F.greatest(F.round(F.col("n") * low / 100), F.lit(1)), F.round(F.col("n") * high / 100)
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.struct("v", (rank - F.col("first") + 1).alias("i"))))
    limits = _ranked(df, keys, value).groupBy(*keys).agg(at(least).alias("__low"), at(most).alias("__high"))
    rows = df.where(finite(F.col(value))).withColumn("__v", F.col(value).cast("double"))
    joined = rows.alias("a").join(limits.alias("b"), same_keys("a", "b", keys)).select("a.*", "__low", "__high") if keys else rows.crossJoin(F.broadcast(limits))  # without keys: one row
    between = joined.where("__v BETWEEN __low.v AND __high.v")
    inner = between.where("__v > __low.v AND __v < __high.v")
    ties = between.where("__v = __low.v OR __v = __high.v").withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__v").orderBy(value, *order)))
    ends = ties.where("(__v > __low.v OR __rank >= __low.i) AND (__v < __high.v OR __rank <= __high.i)")
    return inner.select(*df.columns).unionByName(ends.select(*df.columns))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """basic_statistics of every numeric column: one row a feature."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))))
    return basic_statistics(long, ["feature"], "value")


def position_statistics(df: DataFrame, array: str) -> DataFrame:
    """basic_statistics of every position (from 0) of an array column."""
    return basic_statistics(df.select(F.posexplode(array).alias("position", "value")), ["position"], "value")
