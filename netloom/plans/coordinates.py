"""Queries: projections, filters and coordinates (P), set operations and table assembly (U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import stats
from .registry import Tables, query

SIZE = (24, 24, 100_000)
XYZ = ["x", "y", "z"]


def xyz() -> list:
    return [F.col(k) for k in XYZ]


def r6(value):  # noqa: ANN001, ANN201
    return F.round(value, 6)


@query("p1_index_and_subscripts", "SELECT voxel_id, (voxel_id - 1) % 24 + 1 AS sx, CAST(floor((voxel_id - 1) / 24.0) AS BIGINT) % 24 + 1 AS sy, CAST(floor((voxel_id - 1) / 576.0) AS BIGINT) + 1 AS sz, x + 24 * (y - 1) + 576 * (z - 1) AS back FROM V")
def p1(t: Tables) -> DataFrame:
    sx, sy, sz = c.subscripts(F.col("voxel_id"), SIZE)
    return t.V.select("voxel_id", sx.alias("sx"), sy.alias("sy"), sz.alias("sz"), c.linear_index(xyz(), SIZE).alias("back"))


@query("p2_local_and_global", "SELECT voxel_id, block_id, z - 24 * block_id AS local_z, z - 24 * block_id + (24 * block_id + 1) - 1 AS global_z FROM V")
def p2(t: Tables) -> DataFrame:
    blocks = t.V.select("block_id").distinct().withColumn("low", F.col("block_id") * 24 + 1)
    rows = t.V.join(blocks, "block_id").withColumn("local_z", c.to_local(F.col("z"), F.col("low")))
    return rows.select("voxel_id", "block_id", "local_z", c.to_global(F.col("local_z"), F.col("low")).alias("global_z"))


@query("p3_in_box", "SELECT x, y, z, r FROM V WHERE x BETWEEN 3 AND 20 AND y BETWEEN 2 AND 12 AND z BETWEEN 10 AND 90")
def p3(t: Tables) -> DataFrame:
    return t.V.where(c.in_box(xyz(), (3, 2, 10), (20, 12, 90))).select("x", "y", "z", "r")


@query("p4_on_box_edge", "SELECT voxel_id, x = 1 OR x = 24 OR y = 1 OR y = 24 OR z = 1 OR z = 48 AS on_edge FROM V")
def p4(t: Tables) -> DataFrame:
    return t.V.select("voxel_id", c.on_box_edge(xyz(), (1, 1, 1), (24, 24, 48)).alias("on_edge"))


@query("p5_near_boundary", "WITH near AS (SELECT node FROM N WHERE x <= 50 OR x > 950 OR y <= 50 OR y > 950 OR z <= 50 OR z > 947) SELECT DISTINCT link_label FROM L WHERE node_a IN (SELECT node FROM near) OR node_b IN (SELECT node FROM near)")
def p5(t: Tables) -> DataFrame:
    near = t.N.where(c.near_face(xyz(), (1000, 1000, 997), 50)).select("node")
    ends = t.L.select("link_label", F.explode(F.array("node_a", "node_b")).alias("node"))
    return ends.join(near, "node", "left_semi").select("link_label").distinct()


@query("p6_rescale_and_clamp", "SELECT DISTINCT least(greatest(CAST(round(x * 0.4) AS BIGINT), 1), 9) AS cx, least(greatest(CAST(round(y * 0.4) AS BIGINT), 1), 9) AS cy, least(greatest(CAST(round(z * 0.4) AS BIGINT), 1), 500) AS cz FROM V")
def p6(t: Tables) -> DataFrame:
    return t.V.select(*(c.rescale(F.col(k), 0.4, n).alias(f"c{k}") for k, n in zip(XYZ, (9, 9, 500), strict=True))).distinct()


@query("p7_render_tile_address", "WITH a AS (SELECT voxel_id, least(greatest(CAST(round(z * 1.0 / 0.35) AS BIGINT), 1), 64000) AS pos FROM V) SELECT voxel_id, CAST(ceil(pos / 64.0) AS BIGINT) AS tile, pos - (CAST(ceil(pos / 64.0) AS BIGINT) - 1) * 64 AS inside FROM a")
def p7(t: Tables) -> DataFrame:
    tile, inside = c.tile_address(F.col("z"), 1.0, 0.35, 64, 1000)
    return t.V.select("voxel_id", tile.alias("tile"), inside.alias("inside"))


@query("p8_pixel_to_micrometre", "SELECT voxel_id, round((x - 0.5) * (1.2 / 4) + 7.5, 6) AS um FROM V")
def p8(t: Tables) -> DataFrame:
    return t.V.select("voxel_id", r6(c.pixel_to_um(F.col("x"), 1.2, 2, 7.5)).alias("um"))


@query("p9_unit_scaling", "SELECT link_label, round(length * 1.04, 6) AS length, round(r * 1.1, 6) AS r, round(3.14159 * length * r * r * 1.04 * 1.21, 6) AS volume FROM C")
def p9(t: Tables) -> DataFrame:
    factors = {"length": (1, 0), "r": (0, 1), "volume": (1, 2), "absent": (3, 0)}
    rows = t.C.withColumn("volume", F.lit(3.14159) * F.col("length") * F.col("r") * F.col("r"))
    return rows.select("link_label", *(r6(F.col(k) * 1.04**a * 1.1**b).alias(k) for k, (a, b) in factors.items() if k in rows.columns))


@query("p10_derived_link_columns", "SELECT link_label, round(vx / r, 6) AS dt_cv, round(1 / length, 6) AS tortuosity, round(length + r, 6) AS reach FROM C")
def p10(t: Tables) -> DataFrame:
    return t.C.select("link_label", r6(F.col("vx") / F.col("r")).alias("dt_cv"), r6(1 / F.col("length")).alias("tortuosity"), r6(F.col("length") + F.col("r")).alias("reach"))


@query("p11_derived_node_columns", """
WITH a AS (SELECT l_orderkey AS node, degrees(acos(least(greatest(l_quantity / 25 - 1, -1.0), 1.0))) AS d FROM lineitem)
SELECT node, round(min(d), 6) AS least, CASE WHEN count(*) >= 2 THEN round(median(d), 6) END AS median, round(max(d), 6) AS most FROM a GROUP BY node""")
def p11(t: Tables) -> DataFrame:
    nodes = t.lineitem.groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_list(F.col("l_quantity") / 25 - 1).alias("cosines"))
    low, mid, high = c.array_summary(F.col("degrees"))
    return nodes.withColumn("degrees", c.cosines_to_degrees(F.col("cosines"))).select("node", r6(low).alias("least"), r6(mid).alias("median"), r6(high).alias("most"))


@query("p12_normalised_difference", "SELECT l_orderkey, l_linenumber, round(abs(2 * (l_quantity - l_tax) / (l_quantity + l_tax)), 6) AS difference FROM lineitem")
def p12(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(c.normalised_difference(F.col("l_quantity"), F.col("l_tax"), True)).alias("difference"))


HAZEN = """ranked AS (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t}),
lv AS (SELECT unnest([{levels}]) AS level),
spots AS (SELECT DISTINCT {k}, n, level, least(greatest(n * level / 100 + 0.5, 1), n) AS h FROM ranked, lv),
pct AS (SELECT spots.{k}, spots.level, lo.v + (h - floor(h)) * (hi.v - lo.v) AS percentile FROM spots
  JOIN ranked lo ON lo.{k} = spots.{k} AND lo.i = floor(h) JOIN ranked hi ON hi.{k} = spots.{k} AND hi.i = ceil(h))"""
BY_PRIORITY = {"k": "o_orderpriority", "v": "o_totalprice", "t": "orders"}


@query("p13_percentile_interval", f"WITH {HAZEN.format(**BY_PRIORITY, levels='10.0, 90.0')}, lim AS (SELECT o_orderpriority, min(percentile) AS a, max(percentile) AS b FROM pct GROUP BY 1) SELECT o_orderkey, o_totalprice FROM orders JOIN lim USING (o_orderpriority) WHERE o_totalprice BETWEEN a AND b")
def p13(t: Tables) -> DataFrame:
    return stats.interval_rows(t.orders, ["o_orderpriority"], "o_totalprice", 10, 90).select("o_orderkey", "o_totalprice")


@query("p14_rank_slice", """
WITH ranked AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey FROM ranked WHERE i >= greatest(round(n * 5 / 100.0), 1) AND i <= round(n * 95 / 100.0)""")
def p14(t: Tables) -> DataFrame:
    return stats.rank_slice(t.orders, ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 5, 95).select("o_orderkey")


@query("p15_quartile_outliers", f"WITH {HAZEN.format(**BY_PRIORITY, levels='25.0, 75.0')}, q AS (SELECT o_orderpriority, min(percentile) AS a, max(percentile) AS b FROM pct GROUP BY 1) SELECT o_orderkey, round(a - 0.5 * (b - a), 6) AS low, round(b + 0.5 * (b - a), 6) AS high, NOT (o_totalprice BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)) AS outlier FROM orders JOIN q USING (o_orderpriority)")
def p15(t: Tables) -> DataFrame:
    return stats.outlier_flags(t.orders, ["o_orderpriority"], "o_totalprice", 0.5).select("o_orderkey", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "outlier")


RULES = {"thin_and_long": "r < 0.5 AND length > 40", "wide": "r > 4.8", "dim": "vz < -0.45", "steep": "vx > 0.045 AND vy > 0.03"}


@query("p16_suspect_links", f"""
SELECT link_label, concat_ws(',', {', '.join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in RULES.items())}) AS rules
FROM C WHERE ({' OR '.join(f'({rule})' for rule in RULES.values())}) AND length > 1 AND block_id > 3""")
def p16(t: Tables) -> DataFrame:
    rules = F.concat_ws(",", *(F.when(F.expr(rule), name) for name, rule in RULES.items()))
    return t.C.withColumn("rules", rules).where((F.col("rules") != "") & (F.col("length") > 1) & (F.col("block_id") > 3)).select("link_label", "rules")


@query("p17_row_slice", "SELECT * FROM C WHERE link_label IN (SELECT link_label FROM L)")
def p17(t: Tables) -> DataFrame:
    return t.C.join(t.L.select("link_label"), "link_label", "left_semi").select(*t.C.columns)


@query("u1_union_by_name", "SELECT doc_id, quality, NULL AS toxic FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, NULL, toxic FROM labels WHERE toxic = 1")
def u1(t: Tables) -> DataFrame:
    return t.labels.where("quality = 0").select("doc_id", "quality").unionByName(t.labels.where("toxic = 1").select("doc_id", "toxic"), allowMissingColumns=True)


@query("u2_union_all", "SELECT doc_id, quality, 'a' AS run FROM labels UNION ALL SELECT doc_id, quality, 'b' FROM labels WHERE toxic = 1")
def u2(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", "quality", "toxic")
    return rows.withColumn("run", F.lit("a")).union(rows.where("toxic = 1").withColumn("run", F.lit("b"))).select("doc_id", "quality", "run")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__at = 1").drop("__at")


@query("u3_stable_distinct", "WITH o AS (SELECT x, y, block_id, voxel_id, row_number() OVER (PARTITION BY x, y ORDER BY block_id, voxel_id) AS i FROM V) SELECT x, y, block_id, voxel_id FROM o WHERE i = 1")
def u3(t: Tables) -> DataFrame:
    return first_rows(t.V, ["x", "y"], ["block_id", "voxel_id"]).select("x", "y", "block_id", "voxel_id")


def pair(df: DataFrame, a: str = "node_a", b: str = "node_b") -> DataFrame:
    """Adds u and v, the ends in ascending order."""
    return df.withColumn("u", F.least(a, b)).withColumn("v", F.greatest(a, b))


@query("u4_unordered_difference", "WITH p AS (SELECT *, least(node_a, node_b) AS u, greatest(node_a, node_b) AS v FROM L) SELECT link_label, node_a, node_b FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.intensity < 100 AND q.u = p.u AND q.v = p.v)")
def u4(t: Tables) -> DataFrame:
    links = pair(t.L)
    return links.join(links.where("intensity < 100").select("u", "v"), ["u", "v"], "left_anti").select("link_label", "node_a", "node_b")


@query("u5_merge_columns", "SELECT C.link_label, C.length, L.intensity FROM C LEFT JOIN L USING (link_label)")
def u5(t: Tables) -> DataFrame:
    more = [k for k in t.L.columns if k not in t.C.columns and k == "intensity"]
    return t.C.join(t.L.select("link_label", *more), "link_label", "left").select("link_label", "length", *more)


@query("u6_ragged_arrays", "SELECT l_orderkey AS series, l_linenumber AS bin, l_quantity AS value FROM lineitem")
def u6(t: Tables) -> DataFrame:
    arrays = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("a"))
    return arrays.select(F.col("l_orderkey").alias("series"), F.posexplode_outer("a").alias("at", "e")).select("series", F.col("e.l_linenumber").alias("bin"), F.col("e.l_quantity").alias("value"))


@query("u7_field_extraction", "SELECT block_id, round(avg(length), 6) AS mean_length, max(r) AS most_r FROM C GROUP BY block_id")
def u7(t: Tables) -> DataFrame:
    nested = t.C.groupBy("block_id").agg(F.struct(F.struct(F.avg("length").alias("mean")).alias("length"), F.struct(F.max("r").alias("most")).alias("r")).alias("stat"))
    return nested.select("block_id", r6(F.col("stat.length.mean")).alias("mean_length"), F.col("stat.r.most").alias("most_r"))


@query("u8_group_dimensions", "SELECT c_mktsegment, n_regionkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_regionkey), (c_mktsegment), (n_regionkey), ())")
def u8(t: Tables) -> DataFrame:
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    return joined.cube("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean"))
