"""Queries: ordered and curve functions (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves, stats
from .coordinates import r6
from .registry import Tables, query
from .statistics import EDGES, PRICES, bin_sql, bins_sql, nearest_sql, rounded

CURVES = "points AS (SELECT l_suppkey AS curve, l_quantity AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)"
SEGMENTS = "seg AS (SELECT * FROM (SELECT curve, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM points WINDOW w AS (PARTITION BY curve ORDER BY x)) s WHERE x1 IS NOT NULL)"
SAMPLED = f"""WITH {CURVES}, {SEGMENTS}, grid AS (SELECT range AS i, 2.0 + range * 3.5 AS x FROM range(14)),
sampled AS (SELECT curve, i, x, min(y0 + (y1 - y0) * (x - x0) / (x1 - x0)) AS y FROM grid JOIN seg ON x BETWEEN x0 AND x1 GROUP BY curve, i, x)"""
DAYS = "days AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)"


def points(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("curve"), F.col("l_quantity").alias("x")).agg(F.min("l_extendedprice").alias("y"))


def sampled(t: Tables) -> DataFrame:
    return curves.resample(points(t), ["curve"], "x", "y", 2.0, 3.5, 14)


def days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


CDF = f"cdf AS (SELECT edge, max(c) AS c FROM (SELECT high AS edge, sum(coalesce(k, 0)) OVER (ORDER BY low) / sum(coalesce(k, 0)) OVER () AS c FROM {bins_sql(PRICES)} LEFT JOIN (SELECT {bin_sql('l_extendedprice', PRICES)} AS bin, count(*) AS k FROM lineitem GROUP BY 1) h USING (bin)) e GROUP BY edge)"


@query("w1_cdf_lookup", f"""
WITH {CDF}, u AS (SELECT min(edge) AS edge, c FROM cdf GROUP BY c), s AS (SELECT c AS c0, edge AS e0, lead(c) OVER (ORDER BY c) AS c1, lead(edge) OVER (ORDER BY c) AS e1 FROM u),
q AS (SELECT 0.1 + range * 0.1 AS p FROM range(9))
SELECT range AS i, round(coalesce((SELECT min(e0 + (e1 - e0) * (0.1 + range * 0.1 - c0) / (c1 - c0)) FROM s WHERE c1 IS NOT NULL AND 0.1 + range * 0.1 >= c0 AND 0.1 + range * 0.1 <= c1), CASE WHEN 0.1 + range * 0.1 < (SELECT min(c) FROM u) THEN (SELECT min(edge) FROM u) ELSE (SELECT max(edge) FROM u) END), 4) AS value FROM range(9)""")
def w1(t: Tables) -> DataFrame:
    h = stats.histogram(t.lineitem.where(F.col("l_extendedprice").between(0, 110_000)), "l_extendedprice", PRICES)
    knots = h.select("cdf", ((F.col("bin") + 1) * 10_000.0).alias("edge"))
    inside = curves.resample(knots, [], "cdf", "edge", 0.1, 0.1, 9)
    ends = knots.agg(F.min("cdf").alias("a"), F.min("edge").alias("ea"), F.min_by("edge", F.struct(-F.col("cdf"), F.col("edge"))).alias("eb"))
    grid = t.spark.range(9).select(F.col("id").alias("i"), (F.lit(0.1) + F.col("id") * 0.1).alias("p"))
    outside = F.when(F.col("p") < F.col("a"), F.col("ea")).otherwise(F.col("eb"))
    return grid.crossJoin(F.broadcast(ends)).join(inside.select("i", "y"), "i", "left").select("i", F.round(F.coalesce("y", outside), 4).alias("value"))  # ends: one row


@query("w2_resample", f"{SAMPLED} SELECT curve, i, x, round(y, 6) AS y FROM sampled")
def w2(t: Tables) -> DataFrame:
    return sampled(t).withColumn("y", r6(F.col("y")))


@query("w3_mean_curve", f"{SAMPLED} SELECT i, x, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM sampled GROUP BY i, x")
def w3(t: Tables) -> DataFrame:
    return rounded(curves.mean_curve(sampled(t)))


@query("w4_percentile_curves", f"{SAMPLED} SELECT x, {', '.join(f'round(q{k}, 6) AS q{k}' for k in range(7))} FROM ({nearest_sql('x', 'y', 'sampled')}) p")
def w4(t: Tables) -> DataFrame:
    return rounded(stats.nearest_percentiles(sampled(t), ["x"], "y"))


@query("w5_default_grid", f"WITH {CURVES}, e AS (SELECT min(x) AS a, max(x) AS b, (max(x) - min(x)) / (count(DISTINCT x) - 1) AS s FROM points GROUP BY curve HAVING count(DISTINCT x) > 1) SELECT median(a) AS start, round(median(s), 6) AS step, CAST(ceil((median(b) - median(a)) / median(s)) AS BIGINT) + 1 AS n FROM e")
def w5(t: Tables) -> DataFrame:
    return rounded(curves.default_grid(points(t), ["curve"], "x"))


PDF = f"pdf AS (SELECT l_returnflag AS g, bins.bin, low, high, count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag)) / (high - low) AS pdf FROM lineitem JOIN {bins_sql(EDGES)} ON bins.bin = {bin_sql('l_quantity', EDGES)} GROUP BY 1, 2, 3, 4)"
REBIN = f"""WITH {PDF}, knots AS (SELECT g, high AS x, sum(pdf * (high - low)) OVER (PARTITION BY g ORDER BY low) AS y FROM pdf UNION ALL SELECT g, min(low), 0.0 FROM pdf GROUP BY g),
seg AS (SELECT * FROM (SELECT g, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM knots WINDOW w AS (PARTITION BY g ORDER BY x)) s WHERE x1 IS NOT NULL),
edges AS (SELECT g, i, 0.0 + i * 8.0 AS x FROM (SELECT DISTINCT g FROM pdf) k, (SELECT range AS i FROM range(8)) r),
areas AS (SELECT edges.g, i, coalesce(min(y0 + (y1 - y0) * (x - x0) / (x1 - x0)), 1.0) AS y FROM edges LEFT JOIN seg ON seg.g = edges.g AND x BETWEEN x0 AND x1 GROUP BY edges.g, i),
rebinned AS (SELECT * FROM (SELECT g, i AS bin, greatest((lead(y) OVER (PARTITION BY g ORDER BY i) - y) / 8.0, 0.0) AS pdf FROM areas) a WHERE bin < 7)"""


def pdfs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    counts = t.lineitem.select(F.col("l_returnflag").alias("g"), stats.bin_of(F.col("l_quantity"), EDGES).alias("bin")).where("bin IS NOT NULL").groupBy("g", "bin").agg(F.count("*").alias("c"))
    joined = counts.join(stats.bins(t.lineitem, EDGES), "bin")
    return joined.withColumn("pdf", F.col("c") / F.sum("c").over(Window.partitionBy("g")) / (F.col("high") - F.col("low"))).select("g", "low", "high", "pdf")


@query("w6_rebin_histogram", f"{REBIN} SELECT g, bin, round(pdf, 9) AS pdf FROM rebinned")
def w6(t: Tables) -> DataFrame:
    return curves.rebin(pdfs(t), ["g"], 0.0, 8.0, 7).withColumn("pdf", F.round("pdf", 9))


@query("w7_align_histograms", f"{REBIN} SELECT bin, count(*) AS n, round(avg(pdf), 9) AS mean, round(stddev_pop(pdf), 9) AS std FROM rebinned GROUP BY bin")
def w7(t: Tables) -> DataFrame:
    return curves.rebin(pdfs(t), ["g"], 0.0, 8.0, 7).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("pdf"), 9).alias("mean"), F.round(F.stddev_pop("pdf"), 9).alias("std"))


@query("w8_trim_histogram", f"""
WITH h AS (SELECT {bin_sql('l_extendedprice', PRICES)} AS bin, count(*) AS c FROM lineitem GROUP BY 1),
p AS (SELECT bin, c / (SELECT sum(c) FROM h) AS probability, sum(c) OVER (ORDER BY bin) / (SELECT sum(c) FROM h) AS cdf FROM h)
SELECT bin, round(probability, 9) AS probability, round(cdf, 9) AS cdf FROM p WHERE bin >= coalesce((SELECT max(bin) FROM p WHERE cdf <= 0.2), 0) AND bin <= coalesce((SELECT min(bin) FROM p WHERE cdf >= 0.9), bin)""")
def w8(t: Tables) -> DataFrame:
    h = stats.histogram(t.lineitem, "l_extendedprice", PRICES).where("count > 0").select("bin", "probability")
    return curves.trim(h, 0.2, 0.9).select("bin", F.round("probability", 9).alias("probability"), F.round("cdf", 9).alias("cdf"))


@query("w9_cumulative_total", "SELECT o_orderpriority, value, round(sum(s) OVER (PARTITION BY o_orderpriority ORDER BY value), 2) AS total FROM (SELECT o_orderpriority, floor(o_totalprice / 1000) AS value, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) g")
def w9(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("value", F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return curves.cumulative(rows, ["o_orderpriority"], "value", "o_totalprice").withColumn("total", F.round("total", 2))


@query("w10_zero_crossings", f"WITH {DAYS}, p AS (SELECT day, n - (SELECT avg(n) FROM days) AS y FROM days), s AS (SELECT day AS x0, y AS y0, lead(day) OVER (ORDER BY day) AS x1, lead(y) OVER (ORDER BY day) AS y1 FROM p) SELECT round(x, 6) AS x FROM (SELECT day::DOUBLE AS x FROM p WHERE y = 0 UNION ALL SELECT x0 - y0 * (x1 - x0) / (y1 - y0) FROM s WHERE y0 * y1 < 0) u")
def w10(t: Tables) -> DataFrame:
    daily = days(t)
    mean = daily.agg(F.avg("n").alias("mean"))
    return curves.zero_crossings(daily.crossJoin(F.broadcast(mean)).withColumn("y", F.col("n") - F.col("mean")), [], "day", "y").select(r6(F.col("x")).alias("x"))  # mean: one row


@query("w11_steepest_slope", f"WITH {DAYS}, s AS (SELECT day, (lead(n) OVER w - lag(n) OVER w) / (lead(day) OVER w - lag(day) OVER w) AS slope FROM days WINDOW w AS (ORDER BY day)) SELECT day, round(slope, 6) AS slope FROM s WHERE slope IS NOT NULL ORDER BY slope DESC, day LIMIT 1")
def w11(t: Tables) -> DataFrame:
    return rounded(curves.steepest(days(t), [], "day", "n"))


@query("w12_local_maxima", f"WITH {DAYS}, m AS (SELECT day, n, max(n) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM days) SELECT day, n FROM m WHERE n >= m")
def w12(t: Tables) -> DataFrame:
    return curves.local_maxima(days(t).select("day", "n"), [], "day", "n", 7)


@query("w13_knee", f"""
WITH h AS (SELECT {bin_sql('l_extendedprice', PRICES)} AS bin, count(*) AS c FROM lineitem GROUP BY 1), f AS (SELECT bin, (bin + 0.5) * 10000.0 AS mid, c FROM h WHERE bin IS NOT NULL),
p AS (SELECT bin AS pb, mid AS pm, c AS pc FROM f ORDER BY c DESC, bin LIMIT 1), e AS (SELECT mid AS em, c AS ec FROM f ORDER BY bin DESC LIMIT 1)
SELECT bin, mid, round(abs((ec - pc) * (mid - pm) - (em - pm) * (c - pc)) / sqrt(pow(em - pm, 2) + pow(ec - pc, 2)), 6) AS distance FROM f, p, e WHERE bin >= pb ORDER BY 3 DESC, bin LIMIT 1""")
def w13(t: Tables) -> DataFrame:
    return curves.knee(stats.histogram(t.lineitem, "l_extendedprice", PRICES)).withColumn("distance", r6(F.col("distance")))


@query("w14_first_reach", f"""
WITH {DAYS}, c AS (SELECT day AS x, sum(n) OVER (ORDER BY day) / (SELECT sum(n) FROM days) AS y FROM days), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM c), v AS (SELECT unnest([0.05, 0.5, 0.95]) AS level)
SELECT level::DOUBLE AS level, round(min(x0 + (level::DOUBLE - y0) * (x1 - x0) / (y1 - y0)), 6) AS x FROM s, v WHERE y0 < level::DOUBLE AND y1 >= level::DOUBLE GROUP BY 1""")
def w14(t: Tables) -> DataFrame:
    daily = days(t)
    share = curves.cumulative(daily, [], "day", "n").crossJoin(F.broadcast(daily.agg(F.sum("n").alias("all")))).withColumn("y", F.col("total") / F.col("all"))  # all: one row
    return rounded(curves.first_reach(share, [], "day", "y", (0.05, 0.5, 0.95)))
