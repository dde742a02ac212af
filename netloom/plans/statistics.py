"""Queries: binning, histograms and grouped statistics (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats
from .coordinates import BY_PRIORITY, HAZEN, r6
from .registry import Tables, query

EDGES = [0.0, 5.0, 10.0, 20.0, 35.0, 50.0]
PRICES = [float(x) for x in range(0, 110_001, 10_000)]


def bin_sql(value: str, edges: list[float]) -> str:
    """The bin of a value: left-closed, last bin closed."""
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {value} >= {a} AND {value} {'<=' if i == last else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


def bins_sql(edges: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + ") AS bins(bin, low, high)"


BASIC = "count(*) AS n, round(sum({v}), 4) AS total, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, min({v}) AS least, max({v}) AS most, round(median({v}), 6) AS median, round(max({v}) - min({v}), 6) AS range"


def rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*((F.round(k, 4 if k == "total" else 6).alias(k) if kinds[k] == "double" and k not in ("least", "most") else F.col(k)) for k in df.columns))


@query("a1_group_by_value", "SELECT l_quantity AS value, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_row FROM lineitem GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_row"))


@query("a2_group_by_edges", f"SELECT l_orderkey, l_linenumber, {bin_sql('l_quantity', EDGES)} AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50")
def a2(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", stats.bin_of(F.col("l_quantity"), EDGES).alias("bin")).where("bin IS NOT NULL")


@query("a3_basic_statistics", f"SELECT o_orderpriority, {BASIC.format(v='o_totalprice')} FROM orders GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    return rounded(stats.basic_statistics(t.orders, ["o_orderpriority"], "o_totalprice"))


@query("a4_midpoint_percentiles", f"WITH {HAZEN.format(**BY_PRIORITY, levels=', '.join(str(float(p)) for p in stats.PERCENTILES))} SELECT o_orderpriority, CAST(level AS DOUBLE) AS level, round(percentile, 6) AS percentile FROM pct")
def a4(t: Tables) -> DataFrame:
    return stats.midpoint_percentiles(t.orders, ["o_orderpriority"], "o_totalprice").withColumn("percentile", F.round("percentile", 6))


def nearest_sql(key: str, value: str, source: str) -> str:
    picks = ", ".join(f"max(CASE WHEN i = greatest(ceil(round(n * {p}, 9)), 1) THEN v END) AS q{k}" for k, p in enumerate(stats.NEAREST))
    return f"SELECT {key}, {picks} FROM (SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) o GROUP BY {key}"


@query("a5_nearest_rank_percentiles", nearest_sql("o_orderpriority", "o_totalprice", "orders"))
def a5(t: Tables) -> DataFrame:
    return stats.nearest_percentiles(t.orders, ["o_orderpriority"], "o_totalprice")


HISTOGRAM = "SELECT bins.bin, (low + high) / 2 AS mid, coalesce(c, 0) AS count, round(coalesce(c, 0) / n, 9) AS probability, round(coalesce(c, 0) / n / (high - low), 12) AS pdf, round(sum(coalesce(c, 0)) OVER (ORDER BY bins.bin) / n, 9) AS cdf FROM {bins} LEFT JOIN (SELECT {bin} AS bin, count(*) AS c FROM {t} GROUP BY 1) h USING (bin), (SELECT count(*)::DOUBLE AS n FROM {t}) total"


@query("a6_histogram", HISTOGRAM.format(bins=bins_sql(EDGES), bin=bin_sql("l_quantity", EDGES), t="lineitem").replace("/ n,", "/ (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 0 AND 50),"))
def a6(t: Tables) -> DataFrame:
    h = stats.histogram(t.lineitem, "l_quantity", EDGES)
    return h.select("bin", "mid", "count", F.round("probability", 9).alias("probability"), F.round("pdf", 12).alias("pdf"), F.round("cdf", 9).alias("cdf"))


@query("a7_automatic_histogram", """
WITH s AS (SELECT count(*) AS n, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
k AS (SELECT *, greatest(1, CAST(ceil((hi - lo) / (3.5 * sd * pow(n, -1.0 / 3))) AS BIGINT)) AS k FROM s),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / k)) AS BIGINT), k - 1) AS bin FROM orders, k)
SELECT bin, count(*) AS count FROM b GROUP BY bin""")
def a7(t: Tables) -> DataFrame:
    edges = stats.automatic_edges(t.orders, "o_totalprice")
    low, width, k = edges[0], (edges[-1] - edges[0]) / (len(edges) - 1), len(edges) - 1
    return t.orders.select(F.least(F.floor((F.col("o_totalprice") - low) / width), F.lit(k - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))


@query("a8_large_sample_summary", f"""
WITH h AS ({HISTOGRAM.format(bins=bins_sql(PRICES), bin=bin_sql('l_extendedprice', PRICES), t='lineitem')}), e AS (SELECT h.*, (bin + 1) * 10000.0 AS edge FROM h)
SELECT min(CASE WHEN count > 0 THEN mid END) AS least, max(CASE WHEN count > 0 THEN mid END) AS most, arg_min(edge, abs(cdf - 0.5)) AS median FROM e""")
def a8(t: Tables) -> DataFrame:
    h = stats.histogram(t.lineitem, "l_extendedprice", PRICES).withColumn("edge", (F.col("bin") + 1) * 10000.0)
    filled = F.when(F.col("count") > 0, F.col("mid"))
    return h.agg(F.min(filled).alias("least"), F.max(filled).alias("most"), F.min_by("edge", F.abs(F.col("cdf") - 0.5)).alias("median"))


@query("a9_statistics_in_bins", f"""
WITH k AS (SELECT {bin_sql('l_quantity', EDGES)} AS bin, l_extendedprice AS y FROM lineitem)
SELECT bins.bin, low, high, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(std, 6) AS std, least, most, {', '.join(f'q{i}' for i in range(7))} FROM {bins_sql(EDGES)}
LEFT JOIN (SELECT bin, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS least, max(y) AS most FROM k GROUP BY bin) s ON s.bin = bins.bin
LEFT JOIN ({nearest_sql('bin', 'y', 'k')}) p ON p.bin = bins.bin""")
def a9(t: Tables) -> DataFrame:
    return rounded(stats.binned_statistics(t.lineitem, "l_quantity", "l_extendedprice", EDGES))


@query("a10_statistics_per_index_bin", f"SELECT l_suppkey AS bin, {BASIC.format(v='l_quantity')} FROM lineitem GROUP BY 1")
def a10(t: Tables) -> DataFrame:
    return rounded(stats.basic_statistics(t.lineitem.withColumnRenamed("l_suppkey", "bin"), ["bin"], "l_quantity"))


@query("a11_statistics_per_position", f"SELECT position, {BASIC.format(v='value').replace('6)', '5)')} FROM (SELECT unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) e GROUP BY 1")
def a11(t: Tables) -> DataFrame:
    out = stats.position_statistics(t.embeddings, "embedding")
    return out.select("position", "n", F.round("total", 4).alias("total"), *(F.round(k, 5).alias(k) for k in ("mean", "std")), "least", "most", *(F.round(k, 5).alias(k) for k in ("median", "range")))


@query("a12_statistics_of_columns", f"SELECT feature, {BASIC.format(v='value')} FROM (SELECT 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) u GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    return rounded(stats.column_statistics(t.part, ["p_size", "p_retailprice"]))


@query("a13_mean_and_median", "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def a13(t: Tables) -> DataFrame:
    return rounded(stats.basic_statistics(t.orders, ["o_orderstatus"], "o_totalprice").select("o_orderstatus", "mean", "median"))


JOINT = f"SELECT {bin_sql('l_quantity', EDGES)} AS bin_x, {bin_sql('l_extendedprice', PRICES)} AS bin_y, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_extendedprice BETWEEN 0 AND 110000 GROUP BY 1, 2"


@query("a14_joint_histogram", JOINT)
def a14(t: Tables) -> DataFrame:
    return stats.joint_histogram(t.lineitem, "l_quantity", "l_extendedprice", EDGES, PRICES)


@query("a15_mutual_information", f"WITH j AS ({JOINT}), p AS (SELECT bin_x, bin_y, count / (SELECT sum(count) FROM j) AS p FROM j) SELECT round(sum(p * log2(p / (px * py))), 6) AS bits FROM (SELECT p, sum(p) OVER (PARTITION BY bin_x) AS px, sum(p) OVER (PARTITION BY bin_y) AS py FROM p) m")
def a15(t: Tables) -> DataFrame:
    return rounded(stats.mutual_information(t.lineitem, "l_quantity", "l_extendedprice", EDGES, PRICES))


@query("a16_weighted_sum_by_order", f"""
WITH b AS (SELECT l_orderkey, {bin_sql('l_linenumber', [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1e9])} AS bin, l_quantity FROM lineitem)
SELECT l_orderkey, {', '.join(f'coalesce(sum(CASE WHEN bin = {i} THEN l_quantity END), 0) AS w{i}' for i in range(6))} FROM b GROUP BY 1""")
def a16(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_quantity", stats.bin_of(F.col("l_linenumber"), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1e9]).alias("bin"))
    return rows.groupBy("l_orderkey").agg(*(F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("l_quantity"))), F.lit(0.0)).alias(f"w{i}") for i in range(6)))


@query("a17_max_projection", "SELECT x, y, max(r) AS r FROM V GROUP BY x, y")
def a17(t: Tables) -> DataFrame:
    return t.V.groupBy("x", "y").agg(F.max("r").alias("r"))


@query("a18_sampled_curve_statistics", f"SELECT s.*, round(p.density, 9) AS density FROM (SELECT feature, {BASIC.format(v='value').split(', min')[0]}, round(median(value), 6) AS median FROM (SELECT 'p_size' AS feature, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) u GROUP BY 1) s, (SELECT sum(p_size) / sum(p_retailprice) AS density FROM part) p")
def a18(t: Tables) -> DataFrame:
    ratio = t.part.agg((F.sum("p_size") / F.sum("p_retailprice")).alias("density"))
    return rounded(stats.column_statistics(t.part, ["p_size", "p_retailprice"]).select("feature", "n", "total", "mean", "std", "median")).crossJoin(F.broadcast(ratio)).withColumn("density", F.round("density", 9))  # ratio: one row
