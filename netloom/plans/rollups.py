"""Queries: block, regional and whole-volume rollups (Q), voxel tables (V), tiles (T)."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, moments, spatial, stats
from .coordinates import r6
from .curves import REBIN, pdfs
from .registry import Tables, query
from .statistics import BASIC, bin_sql, rounded

ADJ6 = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1"


def grid(spark, extent: tuple[int, ...], size: int, overlap: int) -> DataFrame:  # noqa: ANN001
    """Blocks of a regular overlapping grid: g0, low0, high0, … per axis, the last one clipped."""
    out = None
    for i, n in enumerate(extent):
        starts = list(range(1, max(n - overlap, 1) + 1, size - overlap))
        axis = spark.createDataFrame([(k + 1, a, min(a + size - 1, n)) for k, a in enumerate(starts)], f"g{i} long, low{i} long, high{i} long")
        out = axis if out is None else out.crossJoin(axis)  # a grid is all combinations of its axes
    return out


def grid_axis_sql(i: int, n: int, size: int, overlap: int) -> str:
    return f"(SELECT range + 1 AS g{i}, 1 + range * {size - overlap} AS low{i}, least({size} + range * {size - overlap}, {n}) AS high{i} FROM range({len(range(1, max(n - overlap, 1) + 1, size - overlap))})) a{i}"


@query("q1_overlapping_grid", f"SELECT * FROM {grid_axis_sql(0, 24, 10, 2)}, {grid_axis_sql(1, 24, 10, 2)}, {grid_axis_sql(2, 48, 20, 4)}, (SELECT count(*) AS voxels FROM V) v")
def q1(t: Tables) -> DataFrame:
    return grid(t.spark, (24, 24), 10, 2).crossJoin(grid(t.spark, (48,), 20, 4).toDF("g2", "low2", "high2")).crossJoin(t.V.agg(F.count("*").alias("voxels")))  # few blocks, one row


@query("q6_object_share_in_blocks", "SELECT x AS object, block_id, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY x)), 9) AS share FROM V GROUP BY x, block_id")
def q6(t: Tables) -> DataFrame:
    counts = t.V.groupBy(F.col("x").alias("object"), "block_id").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("object")), 9))


@query("q7_block_statistics", f"SELECT block_id, round(sum(length) / 1000, 6) AS length_density, round(sum(CASE WHEN r <= 2.5 THEN length ELSE 0 END) / sum(length), 6) AS small_share, round(sum({pi} * length * r * r) / 1000, 6) AS volume_density, round(sum(2 * {pi} * length * r) / 1000, 6) AS surface_density FROM C GROUP BY block_id")
def q7(t: Tables) -> DataFrame:
    length, r = F.col("length"), F.col("r")
    total = F.sum("length")
    return t.C.groupBy("block_id").agg(r6(total / 1000).alias("length_density"), r6(F.sum(F.when(r <= 2.5, length).otherwise(0.0)) / total).alias("small_share"), r6(F.sum(F.lit(pi) * length * r * r) / 1000).alias("volume_density"), r6(F.sum(F.lit(2 * pi) * length * r) / 1000).alias("surface_density"))


@query("q8_block_feature_statistics", f"SELECT block_id, feature, {BASIC.format(v='value').replace('4)', '5)')} FROM (SELECT block_id, 'length' AS feature, length AS value FROM C UNION ALL SELECT block_id, 'r', r FROM C) u GROUP BY 1, 2")
def q8(t: Tables) -> DataFrame:
    long = t.C.select("block_id", F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in ("length", "r")))))
    out = stats.basic_statistics(long, ["block_id", "feature"], "value")
    return rounded(out.drop("total")).join(out.select("block_id", "feature", F.round("total", 5).alias("total")), ["block_id", "feature"])


@query("q9_block_table", "SELECT b.block_id, s.n FROM (SELECT unnest(range((SELECT max(block_id) + 1 FROM V))) AS block_id) b LEFT JOIN (SELECT block_id, count(*) AS n FROM V GROUP BY 1) s USING (block_id)")
def q9(t: Tables) -> DataFrame:
    """A row for each block of the volume, null where it has no voxels."""
    blocks = t.V.agg(F.max("block_id").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block_id"))
    return blocks.join(t.V.groupBy("block_id").agg(F.count("*").alias("n")), "block_id", "left")


@query("q10_whole_graph_statistics", "WITH d AS (SELECT node, count(*) AS degree FROM (SELECT unnest([node_a, node_b]) AS node FROM L) e GROUP BY node) SELECT degree, count(*) AS nodes, (SELECT count(*) FROM L) AS links, (SELECT round(sum(length), 5) FROM L) AS length FROM d GROUP BY degree")
def q10(t: Tables) -> DataFrame:
    degrees = t.L.select(F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    totals = t.L.agg(F.count("*").alias("links"), F.round(F.sum("length"), 5).alias("length"))
    return degrees.groupBy("degree").agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(totals))  # totals: one row


@query("q11_region_extraction", "SELECT c_custkey % 2 AS side, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1 GROUP BY 1")
def q11(t: Tables) -> DataFrame:
    region = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    inside = t.customer.join(F.broadcast(region), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"))  # nation: 25 rows
    return t.orders.join(inside, "o_custkey").groupBy((F.col("o_custkey") % 2).alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("q12_density_by_depth", "SELECT CAST(floor(z / 50.0) AS BIGINT) AS bin, count(*) AS tissue, count(*) FILTER (r > 1) AS links, count(*) FILTER (r BETWEEN 1 AND 2) AS small, round(count(*) FILTER (r > 1) * avg(r) / count(*), 6) AS density FROM V GROUP BY 1")
def q12(t: Tables) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return t.V.groupBy(F.floor(F.col("z") / 50).alias("bin")).agg(F.count("*").alias("tissue"), n(F.col("r") > 1).alias("links"), n(F.col("r").between(1, 2)).alias("small"), r6(n(F.col("r") > 1) * F.avg("r") / F.count("*")).alias("density"))


@query("q14_region_summary", """
WITH s AS (SELECT n_name, c_custkey % 2 AS side, c_mktsegment AS sample, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2, 3)
SELECT n_name, round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS std_of_means, round(avg(d), 6) AS mean_of_stds, round(stddev_pop(d), 6) AS std_of_stds, CAST(sum(n) AS BIGINT) AS blocks FROM s GROUP BY n_name""")
def q14(t: Tables) -> DataFrame:
    rows = t.customer.where("c_acctbal > 0").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    each = rows.groupBy("n_name", (F.col("c_custkey") % 2).alias("side"), F.col("c_mktsegment").alias("sample")).agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("d"), F.count("*").alias("n"))
    return each.groupBy("n_name").agg(r6(F.avg("m")).alias("mean_of_means"), r6(F.stddev_pop("m")).alias("std_of_means"), r6(F.avg("d")).alias("mean_of_stds"), r6(F.stddev_pop("d")).alias("std_of_stds"), F.sum("n").alias("blocks"))


@query("q15_hierarchy_paths", "SELECT n_nationkey, r_name AS level_1, n_name AS level_2, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey")
def q15(t: Tables) -> DataFrame:
    paths = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array("r_name", "n_name").alias("path"))  # region: 5 rows
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return paths.join(counts, "n_nationkey", "left").select("n_nationkey", F.element_at("path", 1).alias("level_1"), F.element_at("path", 2).alias("level_2"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("q16_region_histograms", f"SELECT n_regionkey, c_custkey % 2 AS side, {bin_sql('o_totalprice', [0.0, 100000.0, 200000.0, 300000.0, 600000.0])} AS bin, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3")
def q16(t: Tables) -> DataFrame:
    who = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")  # nation: 25 rows
    rows = t.orders.join(who, "o_custkey")
    return rows.groupBy("n_regionkey", (F.col("o_custkey") % 2).alias("side"), stats.bin_of(F.col("o_totalprice"), [0.0, 100000.0, 200000.0, 300000.0, 600000.0]).alias("bin")).agg(F.count("*").alias("n"))


@query("q19_depth_binned_measures", "WITH z AS (SELECT min(z) AS a, max(z) AS b FROM V), p AS (SELECT least(CAST(floor((z - a) / ((b - a) / 20.0)) AS BIGINT), 19) AS bin, r FROM V, z) SELECT bin, round(avg(r), 6) AS mean, round(median(r), 6) AS median FROM p GROUP BY bin")
def q19(t: Tables) -> DataFrame:
    ends = t.V.agg(F.min("z").alias("a"), F.max("z").alias("b"))
    rows = t.V.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("z") - F.col("a")) / ((F.col("b") - F.col("a")) / 20.0)), F.lit(19)).alias("bin"), "r")  # ends: one row
    return rows.groupBy("bin").agg(r6(F.avg("r")).alias("mean"), r6(F.median("r")).alias("median"))


@query("q20_merged_histogram", f"{REBIN} SELECT bin, round(avg(pdf), 9) AS mean FROM rebinned WHERE pdf > 0.001 GROUP BY bin")
def q20(t: Tables) -> DataFrame:
    from ..operators import curves

    return curves.rebin(pdfs(t), ["g"], 0.0, 8.0, 7).where("pdf > 0.001").groupBy("bin").agg(F.round(F.avg("pdf"), 9).alias("mean"))


@query("v1_block_downsample", "SELECT CAST(floor((x - 1) / 4.0) AS BIGINT) AS bx, CAST(floor((y - 1) / 4.0) AS BIGINT) AS by_, CAST(floor((z - 1) / 4.0) AS BIGINT) AS bz, max(r) AS most, round(avg(r), 6) AS mean FROM V GROUP BY 1, 2, 3")
def v1(t: Tables) -> DataFrame:
    cell = [F.floor((F.col(k) - 1) / 4).alias(n) for k, n in (("x", "bx"), ("y", "by_"), ("z", "bz"))]
    return t.V.groupBy(*cell).agg(F.max("r").alias("most"), r6(F.avg("r")).alias("mean"))


BOX = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
BOX_SQL = "e AS (SELECT max(z) AS zmax FROM V), o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)), p AS (SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM V, o, e WHERE x + dx BETWEEN 1 AND 24 AND y + dy BETWEEN 1 AND 24 AND z + dz BETWEEN 1 AND zmax), w AS (SELECT p.x, p.y, p.z, V.r FROM p CROSS JOIN o CROSS JOIN e LEFT JOIN V ON V.x = least(greatest(p.x + dx, 1), 24) AND V.y = least(greatest(p.y + dy, 1), 24) AND V.z = least(greatest(p.z + dz, 1), zmax))"


def in_boxes(t: Tables) -> DataFrame:
    """x, y, z, r and times: each voxel in all boxes of 3 x 3 x 3 cells that hold it; cells beyond the volume repeat its edge."""
    ends = t.V.agg(F.max("z").alias("zmax"))
    away = spatial.shifted(t.V.crossJoin(F.broadcast(ends)).select("x", "y", "z", "r", "zmax"), BOX).where("nx BETWEEN 1 AND 24 AND ny BETWEEN 1 AND 24 AND nz BETWEEN 1 AND zmax")  # ends: one row
    again = lambda k, last: F.when(F.col(f"n{k}") == F.col(k), 1 + (F.col(k) == 1).cast("int") + (F.col(k) == last).cast("int")).otherwise(1)
    return away.select(*(F.col(f"n{k}").alias(k) for k in "xyz"), "r", (again("x", 24) * again("y", 24) * again("z", F.col("zmax"))).alias("times"))


@query("v3_local_mean_and_std", f"WITH {BOX_SQL} SELECT x, y, z, round(avg(coalesce(r, 0)), 6) AS mean, round(stddev_pop(coalesce(r, 0)), 6) AS std, round(stddev_samp(coalesce(r, 0)), 6) AS sample_std FROM w GROUP BY 1, 2, 3")
def v3(t: Tables) -> DataFrame:
    """Mean and both standard deviations of boxes of 27 cells around, cells without a voxel being 0; boxes without a voxel are left out."""
    times, r = F.col("times"), F.col("r")
    sums = in_boxes(t).groupBy("x", "y", "z").agg(F.sum(times * r).alias("s"), F.sum(times * r * r).alias("q"))
    rest = F.greatest(F.col("q") - F.col("s") * F.col("s") / 27, F.lit(0.0))
    return sums.select("x", "y", "z", r6(F.col("s") / 27).alias("mean"), r6(F.sqrt(rest / 27)).alias("std"), r6(F.sqrt(rest / 26)).alias("sample_std"))


@query("v4_masked_local_mean", f"WITH {BOX_SQL} SELECT w.x, w.y, w.z, CASE WHEN any_value(m.r) >= 2 THEN count(*) FILTER (w.r >= 2) END AS n, CASE WHEN any_value(m.r) >= 2 THEN round(avg(w.r) FILTER (w.r >= 2), 6) END AS mean, CASE WHEN any_value(m.r) >= 2 THEN round(stddev_pop(w.r) FILTER (w.r >= 2), 6) END AS std FROM w JOIN V m ON m.x = w.x AND m.y = w.y AND m.z = w.z GROUP BY 1, 2, 3")
def v4(t: Tables) -> DataFrame:
    """The same over voxels of 2 or more only, for all voxels; null where the voxel itself is below 2."""
    times, r = F.col("times"), F.col("r")
    sums = in_boxes(t).where("r >= 2").groupBy("x", "y", "z").agg(F.sum(times).alias("n"), F.sum(times * r).alias("s"), F.sum(times * r * r).alias("q"))
    rows = t.V.select("x", "y", "z", F.col("r").alias("own")).join(sums, ["x", "y", "z"], "left")
    mask = lambda c: F.when(F.col("own") >= 2, c)
    rest = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return rows.select("x", "y", "z", mask(F.col("n")).alias("n"), mask(r6(F.col("s") / F.col("n"))).alias("mean"), mask(r6(F.sqrt(rest / F.col("n")))).alias("std"))


@query("v5_contrast_stretch", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), m AS (SELECT l_suppkey, max(CASE WHEN i = greatest(floor((n * 5 + 50) / 100), 1) THEN l_extendedprice END) AS a, max(CASE WHEN i = floor((n * 95 + 50) / 100) THEN l_extendedprice END) AS b FROM o GROUP BY 1) SELECT l_orderkey, l_linenumber, round(CASE WHEN a = b THEN l_extendedprice ELSE (least(greatest(l_extendedprice, a), b) - a) / (b - a) END, 6) AS v FROM lineitem JOIN m USING (l_suppkey)")
def v5(t: Tables) -> DataFrame:
    ranked = stats._ranked(t.lineitem, ["l_suppkey"], "l_extendedprice")
    limits = ranked.groupBy("l_suppkey").agg(stats._pick(F.greatest(F.floor((F.col("n") * 5 + 50) / 100), F.lit(1))).alias("a"), stats._pick(F.floor((F.col("n") * 95 + 50) / 100)).alias("b"))
    p, a, b = F.col("l_extendedprice"), F.col("a"), F.col("b")
    return t.lineitem.join(limits, "l_suppkey").select("l_orderkey", "l_linenumber", r6(F.when(a == b, p).otherwise((F.least(F.greatest(p, a), b) - a) / (b - a))).alias("v"))


REACH_V = "adj AS (SELECT a.voxel_id AS u, b.voxel_id AS v FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1), reach(voxel, root) AS (SELECT voxel_id, voxel_id FROM m UNION SELECT adj.v, reach.root FROM reach JOIN adj ON adj.u = reach.voxel), comp AS (SELECT voxel, min(root) AS component FROM reach GROUP BY voxel)"


def voxel_components(voxels: DataFrame) -> DataFrame:
    """``voxels`` with component, by 26 neighbours."""
    return voxels.join(spatial.touching(voxels, "voxel_id").withColumnRenamed("node", "voxel_id"), "voxel_id")


@query("v6_hysteresis_threshold", f"WITH RECURSIVE m AS (SELECT * FROM V WHERE r >= 2), {REACH_V} SELECT voxel AS voxel_id FROM comp WHERE component IN (SELECT component FROM comp JOIN V ON voxel_id = voxel WHERE r >= 4.9)")
def v6(t: Tables) -> DataFrame:
    labelled = voxel_components(t.V.where("r >= 2"))
    return labelled.join(labelled.where("r >= 4.9").select("component").distinct(), "component", "left_semi").select("voxel_id")


@query("v9_component_surface", f"WITH RECURSIVE m AS (SELECT * FROM V WHERE r >= 2), {REACH_V}, faces AS (SELECT a.voxel_id, 6 - count(b.voxel_id) AS open FROM m a LEFT JOIN m b ON {ADJ6} GROUP BY 1) SELECT component, CAST(sum(open) AS BIGINT) AS surface, count(*) AS voxels FROM faces JOIN comp ON voxel = voxel_id GROUP BY component")
def v9(t: Tables) -> DataFrame:
    mask = t.V.where("r >= 2")
    closed = spatial.neighbours(mask, "voxel_id", spatial.FACES, mirror=False).groupBy(F.col("u").alias("voxel_id")).agg(F.count("*").alias("c"))
    rows = voxel_components(mask).join(closed, "voxel_id", "left")
    return rows.groupBy("component").agg(F.sum(6 - F.coalesce("c", F.lit(0))).alias("surface"), F.count("*").alias("voxels"))


@query("v10_component_size_filter", f"WITH RECURSIVE m AS (SELECT * FROM V WHERE r >= 2), {REACH_V} SELECT voxel AS voxel_id FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 3)")
def v10(t: Tables) -> DataFrame:
    labelled = voxel_components(t.V.where("r >= 2"))
    return labelled.join(labelled.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3"), "component", "left_semi").select("voxel_id")


@query("v13_block_intensity", "SELECT block_id, count(*) AS n, min(r) AS least, max(r) AS most, round(count(*) FILTER (r >= 4.9) / count(*), 9) AS saturated, round(avg(r) FILTER (r < 2.5), 6) AS background FROM V WHERE r > 0 GROUP BY block_id")
def v13(t: Tables) -> DataFrame:
    r = F.col("r")
    return t.V.where("r > 0").groupBy("block_id").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most"), F.round(F.count(F.when(r >= 4.9, 1)) / F.count("*"), 9).alias("saturated"), r6(F.avg(F.when(r < 2.5, r))).alias("background"))


@query("t1_expected_shift", "SELECT a.tile, b.tile AS other, round((b.model - a.model) / 0.3, 6) AS shift FROM T a JOIN T b ON b.gx = a.gx + 1 AND b.gy = a.gy AND b.gz = a.gz")
def t1(t: Tables) -> DataFrame:
    other = t.T.select(F.col("tile").alias("other"), (F.col("gx") - 1).alias("gx"), "gy", "gz", F.col("model").alias("m"))
    return t.T.join(other, ["gx", "gy", "gz"]).select("tile", "other", r6((F.col("m") - F.col("model")) / 0.3).alias("shift"))


@query("t2_overlap_selection", "SELECT node, side FROM N WHERE (side = 0 AND x >= 800) OR (side = 1 AND x + 800 <= 1003)")
def t2(t: Tables) -> DataFrame:
    return t.N.where(((F.col("side") == 0) & (F.col("x") >= 800)) | ((F.col("side") == 1) & (F.col("x") + 800 <= 1003))).select("node", "side")


@query("t4_coverage_test", "WITH c AS (SELECT node % 7 AS tile, CASE WHEN x > 500 THEN 1 ELSE 0 END AS i, CASE WHEN y > 500 THEN 1 ELSE 0 END AS j, count(*) AS n FROM N GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY tile) / 4.0 AS mean FROM c) SELECT tile, NOT (count(DISTINCT CASE WHEN n > mean THEN i END) = 2 AND count(DISTINCT CASE WHEN n > mean THEN j END) = 2) AS flagged FROM m GROUP BY tile")
def t4(t: Tables) -> DataFrame:
    counts = t.N.groupBy((F.col("node") % 7).alias("tile"), (F.col("x") > 500).cast("int").alias("i"), (F.col("y") > 500).cast("int").alias("j")).agg(F.count("*").alias("n"))
    above = F.col("n") > F.sum("n").over(Window.partitionBy("tile")) / 4.0
    marked = counts.withColumn("above", above)
    full = [F.count_distinct(F.when(F.col("above"), F.col(k))) == 2 for k in "ij"]
    return marked.groupBy("tile").agg((~(full[0] & full[1])).alias("flagged"))


CURVE = "sums AS (SELECT l_suppkey AS tile, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM (SELECT l_suppkey, l_quantity - 25.0 AS x, l_extendedprice / 10000.0 AS y FROM lineitem) p GROUP BY 1 HAVING count(*) >= 3), fit AS (SELECT tile, n, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d AS c0, (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d AS c1, (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d AS c2 FROM (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d FROM sums) q WHERE d <> 0)"


@query("t6_curvature_model", f"WITH {CURVE}, rest AS (SELECT l_suppkey AS tile, count(*) FILTER (abs(l_extendedprice / 10000.0 - (c0 + c1 * (l_quantity - 25.0) + c2 * pow(l_quantity - 25.0, 2))) > 2) AS outliers FROM lineitem JOIN fit ON tile = l_suppkey GROUP BY 1) SELECT tile, n::BIGINT AS n, round(CASE WHEN abs(c2) > 0.0001 THEN 25 - c1 / (2 * c2) END, 2) AS p1, round(-c2, 6) AS p2, round(CASE WHEN abs(c2) > 0.0001 THEN c0 - c1 * c1 / (4 * c2) END, 4) AS p3, outliers, outliers < 0.25 * n AS valid FROM fit JOIN rest USING (tile)")
def t6(t: Tables) -> DataFrame:
    """y = p3 - p2 (x - p1)^2 of each tile; rows more than 2 off are outliers, and a model with under a quarter of them is valid. A line (no curvature) has no p1 and p3."""
    x, y = F.col("l_quantity") - 25.0, F.col("l_extendedprice") / 10000.0  # centred, so the sums are well conditioned
    fit = moments.quadratic(t.lineitem, ["l_suppkey"], x, y).where("c2 IS NOT NULL")
    off = F.abs(y - (F.col("c0") + F.col("c1") * x + F.col("c2") * x * x))
    rest = t.lineitem.join(fit, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.when(off > 2, 1)).alias("outliers"))
    c0, c1, c2 = (F.col(f"c{k}") for k in range(3))
    bent = lambda v: F.when(F.abs(c2) > 0.0001, v)
    return fit.join(rest, "l_suppkey").select(F.col("l_suppkey").alias("tile"), "n", F.round(bent(25 - c1 / (2 * c2)), 2).alias("p1"), F.round(-c2, 6).alias("p2"), F.round(bent(c0 - c1 * c1 / (4 * c2)), 4).alias("p3"), "outliers", (F.col("outliers") < 0.25 * F.col("n")).alias("valid"))


@query("t9_uniform_sample", "WITH o AS (SELECT node, row_number() OVER (PARTITION BY floor(x / 250.0), floor(y / 250.0), floor(z / 250.0) ORDER BY md5(node::VARCHAR || '|7')) AS i FROM N) SELECT node FROM o WHERE i <= 5")
def t9(t: Tables) -> DataFrame:
    return spatial.first_per_cell(t.N, 250, 5, [F.md5(F.concat_ws("|", F.col("node").cast("string"), F.lit("7")))]).select("node")


@query("t10_cell_averages", "SELECT CAST(floor(x / 6.0) AS BIGINT) AS c0, CAST(floor(y / 6.0) AS BIGINT) AS c1, CAST(floor(z / 6.0) AS BIGINT) AS c2, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(r), 6) AS r FROM V GROUP BY 1, 2, 3")
def t10(t: Tables) -> DataFrame:
    return spatial.cells(t.V, 6).groupBy("c0", "c1", "c2").agg(*(r6(F.avg(k)).alias(k) for k in ("x", "y", "z", "r")))


@query("t11_object_consistency", "SELECT node_a AS object, count(*) AS points, count(DISTINCT node_b) AS partners FROM M GROUP BY 1 HAVING count(DISTINCT node_b) <= 0.9 * count(*)")
def t11(t: Tables) -> DataFrame:
    return t.M.groupBy(F.col("node_a").alias("object")).agg(F.count("*").alias("points"), F.count_distinct("node_b").alias("partners")).where("partners <= 0.9 * points")


@query("t13_matched_segment_radii", "SELECT l.link_label, round(l.r, 6) AS one, round(c.r, 6) AS two, round(2 * (l.r - c.r) / (l.r + c.r), 6) AS difference FROM L l JOIN C c ON c.link_label = l.link_label")
def t13(t: Tables) -> DataFrame:
    both = t.L.select("link_label", F.col("r").alias("one")).join(t.C.select("link_label", F.col("r").alias("two")), "link_label")
    return both.select("link_label", r6(F.col("one")).alias("one"), r6(F.col("two")).alias("two"), r6(2 * (F.col("one") - F.col("two")) / (F.col("one") + F.col("two"))).alias("difference"))


@query("t15_best_match_version", "SELECT gx, gy, arg_max(tile, model) AS tile, max(model) AS model FROM T GROUP BY gx, gy")
def t15(t: Tables) -> DataFrame:
    return t.T.groupBy("gx", "gy").agg(F.max_by("tile", "model").alias("tile"), F.max("model").alias("model"))


@query("t17_strongest_points", "WITH o AS (SELECT node, side, row_number() OVER (PARTITION BY side ORDER BY y DESC, node) AS i FROM N WHERE y > 100) SELECT node, side FROM o WHERE i <= 40")
def t17(t: Tables) -> DataFrame:
    w = Window.partitionBy("side").orderBy(F.desc("y"), "node")
    return t.N.where("y > 100").withColumn("i", F.row_number().over(w)).where("i <= 40").select("node", "side")


@query("t18_residual_rejection", "WITH m AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber FROM lineitem JOIN m USING (l_suppkey) WHERE abs(l_extendedprice - (a + b * l_quantity)) < 5000")
def t18(t: Tables) -> DataFrame:
    model = t.lineitem.groupBy("l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"), F.regr_intercept("l_extendedprice", "l_quantity").alias("a"))
    return t.lineitem.join(model, "l_suppkey").where(F.abs(F.col("l_extendedprice") - (F.col("a") + F.col("b") * F.col("l_quantity"))) < 5000).select("l_orderkey", "l_linenumber")


@query("t19_mirrored_axes", "SELECT node, 1001 - x AS x, 1001 - y AS y, z FROM N")
def t19(t: Tables) -> DataFrame:
    return t.N.select("node", (1001 - F.col("x")).alias("x"), (1001 - F.col("y")).alias("y"), "z")


