"""Queries: joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.graph import link_edges, ordered_pair, spread
from .coordinates import r6, xyz
from .registry import Tables, query

D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("j1_label_lookup", "SELECT V.block_id, count(*) AS n, count(DISTINCT L.link_label) AS labels, bool_or(L.link_label IS NULL) AS unlabelled FROM V LEFT JOIN L ON L.link_label = V.voxel_id GROUP BY 1")
def j1(t: Tables) -> DataFrame:
    joined = t.V.join(t.L.select("link_label"), F.col("voxel_id") == F.col("link_label"), "left")
    return joined.groupBy("block_id").agg(F.count("*").alias("n"), F.count_distinct("link_label").alias("labels"), F.bool_or(F.col("link_label").isNull()).alias("unlabelled"))


@query("j2_endpoint_pair_features", "WITH p AS (SELECT *, least(node_a, node_b) AS u, greatest(node_a, node_b) AS v FROM M), q AS (SELECT u, v, min(link_label) AS match FROM p GROUP BY u, v HAVING count(*) = 1) SELECT p.link_label, q.match FROM p LEFT JOIN q ON p.u = q.u AND p.v = q.v")
def j2(t: Tables) -> DataFrame:
    links = ordered_pair(t.M)
    one = links.groupBy("u", "v").agg(F.min("link_label").alias("match"), F.count("*").alias("n")).where("n = 1").drop("n")
    return links.join(one, ["u", "v"], "left").select("link_label", "match")


@query("j3_radius_join", f"SELECT a.node AS a, b.node AS b, round({D3}, 6) AS distance FROM N a JOIN N b ON a.node < b.node WHERE {D3} <= 50 AND {D3} > 0")
def j3(t: Tables) -> DataFrame:
    return spatial.radius_pairs(t.N, "node", 50).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), r6(F.col("distance")).alias("distance"))


@query("j4_mutual_nearest", f"""
WITH p AS (SELECT a.node AS a, b.node AS b, {D3} AS d FROM N a JOIN N b ON a.side = 0 AND b.side = 1 WHERE {D3} <= 120),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rb FROM p)
SELECT a, b, round(d, 6) AS distance FROM r WHERE ra = 1 AND rb = 1""")
def j4(t: Tables) -> DataFrame:
    return spatial.mutual_nearest(t.N.where("side = 0"), t.N.where("side = 1"), "node", 120).select("a", "b", r6(F.col("distance")).alias("distance"))


@query("j5_nearest_source", f"""
WITH p AS (SELECT a.x, a.y, a.z, min(struct_pack(d := {D3}, v := b.voxel_id)) AS m FROM V a, V b WHERE a.r < 1 AND b.r >= 4 GROUP BY 1, 2, 3)
SELECT x, y, z, m.v AS voxel_id, round(m.d, 6) AS distance FROM p""")
def j5(t: Tables) -> DataFrame:
    return spatial.nearest_source(t.V.where("r < 1"), t.V.where("r >= 4"), "voxel_id").withColumn("distance", r6(F.col("distance")))


CENTRES = "centres AS (SELECT tile, (gx - 0.5) * 200.0 AS x, (gy - 0.5) * 200.0 AS y, (gz - 0.5) * 250.0 AS z FROM T)"


def centres(t: Tables) -> DataFrame:
    return t.T.select("tile", *(((F.col(g) - 0.5) * s).alias(k) for g, k, s in (("gx", "x", 200.0), ("gy", "y", 200.0), ("gz", "z", 250.0))))


@query("j6_nearest_centre", f"WITH {CENTRES}, p AS (SELECT a.node, b.tile, {D3} AS d FROM N a, centres b), o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, tile) AS i FROM p) SELECT node, tile AS nearest_tile, round(d, 6) AS distance FROM o WHERE i = 1")
def j6(t: Tables) -> DataFrame:
    out = spatial.nearest_centre(t.N.select("node", *xyz()), centres(t), "tile", 200)
    return out.select("node", "nearest_tile", r6(F.col("distance")).alias("distance"))


@query("j7_weighted_nearest_fallback", """
WITH p AS (SELECT a.tile, b.tile AS other, b.model, sqrt(pow(a.gx - b.gx, 2) + pow((a.gy - b.gy) * 2.5, 2) + pow((a.gz - b.gz) * 1e5, 2)) AS d FROM T a, T b WHERE NOT a.reliable AND b.reliable),
o AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY d, other) AS i FROM p)
SELECT tile, CASE WHEN T.reliable THEN T.model ELSE o.model END AS model FROM T LEFT JOIN (SELECT tile, model FROM o WHERE i = 1) o USING (tile)""")
def j7(t: Tables) -> DataFrame:
    at = [F.col(g).alias(k) for g, k in (("gx", "x"), ("gy", "y"), ("gz", "z"))]
    good, bad = t.T.where("reliable"), t.T.where("NOT reliable")
    taken = spatial.nearest_centre(bad.select("tile", *at), good.select("tile", *at), "tile", 4, (1, 2.5, 1e5)).select("tile", "nearest_tile")
    models = taken.join(good.select(F.col("tile").alias("nearest_tile"), "model"), "nearest_tile").select("tile", "model")
    return good.select("tile", "model").unionByName(models)


@query("j8_face_adjacency", "SELECT a.tile, max(CASE WHEN b.gx = a.gx + 1 THEN b.tile END) AS east, max(CASE WHEN b.gx = a.gx - 1 THEN b.tile END) AS west, max(CASE WHEN b.gy = a.gy + 1 THEN b.tile END) AS north, max(CASE WHEN b.gy = a.gy - 1 THEN b.tile END) AS south, max(CASE WHEN b.gz = a.gz + 1 THEN b.tile END) AS up, max(CASE WHEN b.gz = a.gz - 1 THEN b.tile END) AS down FROM T a LEFT JOIN T b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) + abs(a.gz - b.gz) = 1 GROUP BY a.tile")
def j8(t: Tables) -> DataFrame:
    tiles = t.T.select("tile", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))
    away = spatial.shifted(tiles, spatial.FACES).withColumn("side", F.concat_ws(",", *((F.col(f"n{k}") - F.col(k)).cast("string") for k in "xyz")))
    other = tiles.select(F.col("tile").alias("other"), *(F.col(k).alias(f"n{k}") for k in "xyz"))
    named = zip(spatial.FACES, ("east", "west", "north", "south", "up", "down"), strict=True)
    return away.join(other, ["nx", "ny", "nz"], "left").groupBy("tile").agg(*(F.max(F.when(F.col("side") == ",".join(map(str, s)), F.col("other"))).alias(n) for s, n in named))


def placed_links(t: Tables) -> DataFrame:
    """Links with the coordinates of both ends."""
    at = lambda end: t.N.select(F.col("node").alias(f"node_{end}"), *(F.col(k).alias(f"{end}{k}") for k in "xyz"))
    return t.L.join(at("a"), "node_a").join(at("b"), "node_b")


PLACED = "placed AS (SELECT L.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz FROM L JOIN N p ON p.node = node_a JOIN N q ON q.node = node_b)"


@query("j9_close_pairs", f"WITH {PLACED} SELECT a.link_label AS first, b.link_label AS second FROM placed a JOIN placed b ON a.link_label < b.link_label WHERE sqrt(pow(a.ax - b.ax, 2) + pow(a.ay - b.ay, 2) + pow(a.az - b.az, 2)) <= 150 AND sqrt(pow(a.bx - b.bx, 2) + pow(a.by_ - b.by_, 2) + pow(a.bz - b.bz, 2)) <= 150")
def j9(t: Tables) -> DataFrame:
    return spatial.close_pairs(placed_links(t), "link_label", 150)


@query("j10_mask_share_of_blocks", "SELECT block_id, count(*) / (24 * 24 * 24.0) AS share FROM V WHERE r > 1 GROUP BY block_id")
def j10(t: Tables) -> DataFrame:
    return t.V.where("r > 1").groupBy("block_id").agg((F.count("*") / (24 * 24 * 24.0)).alias("share"))


@query("j11_ancestors", "SELECT c_custkey, 'n' || n_nationkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j11(t: Tables) -> DataFrame:
    paths = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey")).alias("path"))
    return t.customer.join(F.broadcast(paths), "c_nationkey").select("c_custkey", F.explode("path").alias("region"))  # nation: 25 rows


@query("j12_candidates_with_partner", "SELECT node FROM N a WHERE side = 0 AND EXISTS (SELECT 1 FROM N b WHERE b.side = 1 AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100 AND abs(a.z - b.z) <= 100)")
def j12(t: Tables) -> DataFrame:
    a = spatial.cells(t.N.where("side = 0"), 100).alias("a")
    b = spatial.cells(t.N.where("side = 1"), 100, spread=1).alias("b")
    near = [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(3)] + [F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) <= 100 for k in "xyz"]
    on = near[0]
    for c in near[1:]:
        on = on & c
    return a.join(b, on, "left_semi").select("node")


@query("j13_link_neighbours", """
WITH e AS (SELECT DISTINCT p.link_label AS u, q.link_label AS v FROM L p JOIN L q ON p.node_a IN (q.node_a, q.node_b) OR p.node_b IN (q.node_a, q.node_b)),
s AS (SELECT link_label AS u FROM L WHERE intensity < 5), one AS (SELECT u FROM s UNION SELECT v FROM e WHERE u IN (SELECT u FROM s))
SELECT DISTINCT link_label FROM (SELECT u AS link_label FROM one UNION SELECT v FROM e WHERE u IN (SELECT u FROM one)) x""")
def j13(t: Tables) -> DataFrame:
    start = t.L.where("intensity < 5").select(F.col("link_label").alias("node"))
    return spread(start, link_edges(t.L), 2).select(F.col("node").alias("link_label"))


