"""Queries: spatial graphs (G) and their refinement (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, spatial
from .coordinates import r6
from .joins import placed_links
from .registry import Tables, query

ADJACENT = "adj AS (SELECT a.voxel_id AS u, b.voxel_id AS v FROM V a JOIN V b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.voxel_id <> b.voxel_id)"
CLASSES = f"{ADJACENT}, classes AS (SELECT voxel_id, count(v) AS n, CASE count(v) WHEN 0 THEN 'isolated' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'link' ELSE 'node' END AS kind FROM V LEFT JOIN adj ON u = voxel_id GROUP BY voxel_id)"
REACH = "e AS (SELECT node_a AS u, node_b AS v FROM {t} UNION SELECT node_b, node_a FROM {t}), reach(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"


def classes(t: Tables) -> DataFrame:
    pairs = spatial.neighbours(t.V, "voxel_id").groupBy(F.col("u").alias("voxel_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    kind = F.when(n == 0, "isolated").when(n == 1, "endpoint").when(n == 2, "link").otherwise("node")
    return t.V.join(pairs, "voxel_id", "left").select("voxel_id", "x", "y", "z", "r", "block_id", n.alias("n"), kind.alias("kind"))


@query("g1_adjacency", f"WITH {ADJACENT} SELECT u, v FROM adj")
def g1(t: Tables) -> DataFrame:
    return spatial.neighbours(t.V, "voxel_id")


@query("g2_voxel_classes", f"WITH {CLASSES} SELECT voxel_id, n, kind FROM classes")
def g2(t: Tables) -> DataFrame:
    return classes(t).select("voxel_id", "n", "kind")


@query("g3_node_components", f"WITH RECURSIVE {CLASSES}, ne AS (SELECT u, v FROM adj WHERE u IN (SELECT voxel_id FROM classes WHERE kind = 'node') AND v IN (SELECT voxel_id FROM classes WHERE kind = 'node')), reach(node, root) AS (SELECT voxel_id, voxel_id FROM classes WHERE kind = 'node' UNION SELECT ne.v, reach.root FROM reach JOIN ne ON ne.u = reach.node) SELECT node AS voxel_id, min(root) AS label FROM reach GROUP BY node")
def g3(t: Tables) -> DataFrame:
    nodes = classes(t).where("kind = 'node'")
    return spatial.touching(nodes, "voxel_id").select(F.col("node").alias("voxel_id"), F.col("component").alias("label"))


@query("g6_connected_components", f"WITH RECURSIVE {REACH.format(t='L')} SELECT node, component FROM comp")
def g6(t: Tables) -> DataFrame:
    return graph.components(graph.both_ways(t.L))


@query("g7_component_sizes", f"WITH RECURSIVE {REACH.format(t='L')}, s AS (SELECT component, count(*) AS links, sum(length) AS length FROM L JOIN comp ON node = node_a GROUP BY 1) SELECT component, links, round(length, 4) AS length, round(links / (SELECT sum(links) FROM s), 9) AS share FROM s")
def g7(t: Tables) -> DataFrame:
    sizes = graph.link_components(t.L).groupBy("component").agg(F.count("*").alias("links"), F.round(F.sum("length"), 4).alias("length"))
    return sizes.withColumn("share", F.round(F.col("links") / F.sum("links").over(Window.partitionBy(F.lit(0))), 9))


@query("g8_small_component_filter", f"WITH RECURSIVE {REACH.format(t='L')} SELECT link_label FROM L JOIN comp ON node = node_a WHERE component IN (SELECT component FROM L JOIN comp ON node = node_a GROUP BY 1 HAVING count(*) >= 3)")
def g8(t: Tables) -> DataFrame:
    labelled = graph.link_components(t.L)
    large = labelled.groupBy("component").agg(F.count("*").alias("n")).where("n >= 3")
    return labelled.join(large, "component", "left_semi").select("link_label")


@query("g9_simple_graph", "WITH p AS (SELECT link_label, length, least(node_a, node_b) AS u, greatest(node_a, node_b) AS v FROM M WHERE node_a <> node_b), o AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY link_label) AS i FROM p) SELECT u, v, link_label, length FROM o WHERE i = 1")
def g9(t: Tables) -> DataFrame:
    return graph.simple_graph(t.M, "length")


@query("g10_self_loops", "SELECT link_label, node_a, n_voxel FROM M WHERE node_a = node_b")
def g10(t: Tables) -> DataFrame:
    return t.M.where("node_a = node_b").select("link_label", "node_a", "n_voxel")


@query("g11_parallel_links", "SELECT least(node_a, node_b) AS u, greatest(node_a, node_b) AS v, count(*) AS n, string_agg(link_label::VARCHAR, ',' ORDER BY link_label) AS labels, round(sum(length), 5) AS length FROM M WHERE node_a <> node_b GROUP BY 1, 2 HAVING count(*) > 1")
def g11(t: Tables) -> DataFrame:
    out = graph.parallel_links(t.M)
    return out.withColumn("labels", F.concat_ws(",", F.col("labels").cast("array<string>"))).withColumn("length", F.round("length", 5))


ORDER_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT p.link_label AS u, q.link_label AS v FROM (SELECT link_label, unnest([node_a, node_b]) AS node FROM L) p JOIN (SELECT link_label, unnest([node_a, node_b]) AS node FROM L) q USING (node) WHERE p.link_label <> q.link_label),
w(link_label, rank) AS (SELECT link_label, 0 FROM L WHERE intensity < 10 UNION SELECT e.v, w.rank + 1 FROM w JOIN e ON e.u = w.link_label WHERE w.rank < {most})
SELECT link_label, CAST(min(rank) AS INTEGER) AS rank FROM w GROUP BY 1"""


@query("g14_branching_order", """
WITH RECURSIVE ends AS (SELECT link_label, unnest([node_a, node_b]) AS node FROM L), e AS MATERIALIZED (SELECT DISTINCT p.link_label AS u, q.link_label AS v FROM ends p JOIN ends q USING (node) WHERE p.link_label <> q.link_label),
w(link_label, rank) USING KEY (link_label) AS (SELECT link_label, 0 FROM L WHERE intensity < 10 UNION SELECT e.v, min(w.rank) + 1 FROM w JOIN e ON e.u = w.link_label ANTI JOIN recurring.w r ON r.link_label = e.v GROUP BY e.v)
SELECT link_label, CAST(rank AS INTEGER) AS rank FROM L LEFT JOIN w USING (link_label)""")
def g14(t: Tables) -> DataFrame:
    """Steps to the nearest labelled link; null where none is reached."""
    start = t.L.where("intensity < 10").select(F.col("link_label").alias("node"))
    found = graph.spread(start, graph.link_edges(t.L)).withColumnRenamed("node", "link_label")
    return t.L.select("link_label").join(found, "link_label", "left")


@query("g15_neighbourhood_by_order", ORDER_SQL.format(most=2).replace("intensity < 10", "link_label = (SELECT min(link_label) FROM L)"))
def g15(t: Tables) -> DataFrame:
    start = t.L.agg(F.min("link_label").alias("node"))
    return graph.spread(start, graph.link_edges(t.L), 2).withColumnRenamed("node", "link_label")


@query("g16_subgraph", "WITH k AS (SELECT * FROM L WHERE length > 100), n AS (SELECT node, row_number() OVER (ORDER BY node) AS label FROM (SELECT node_a AS node FROM k UNION SELECT node_b FROM k) u) SELECT link_label, p.label AS a, q.label AS b FROM k JOIN n p ON p.node = node_a JOIN n q ON q.node = node_b")
def g16(t: Tables) -> DataFrame:
    kept = t.L.where("length > 100")
    nodes = dense_labels(kept.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct(), "node")
    end = lambda k, n: nodes.select(F.col("node").alias(k), F.col("label").alias(n))
    return kept.join(end("node_a", "a"), "node_a").join(end("node_b", "b"), "node_b").select("link_label", "a", "b")


def dense_labels(df: DataFrame, key: str, span: int = 4096) -> DataFrame:
    """``df`` (distinct long keys) with consecutive labels from 1 by key: ranks in spans of the key, offsets by span, no global sort."""
    cut = df.withColumn("__span", F.floor(F.col(key) / span))
    counts = cut.groupBy("__span").agg(F.count("*").alias("n"))
    before = counts.select("__span", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__span").orderBy(key)))
    return ranked.join(before, "__span").withColumn("label", F.col("before") + F.col("__r")).drop("__span", "__r", "before")


@query("g17_relabel", "SELECT link_label, row_number() OVER (ORDER BY link_label) AS label FROM L WHERE intensity > 50")
def g17(t: Tables) -> DataFrame:
    return dense_labels(t.L.where("intensity > 50").select("link_label"), "link_label")


@query("g19_repeated_links", "SELECT link_label FROM M WHERE intensity < 100 AND (least(node_a, node_b), greatest(node_a, node_b)) IN (SELECT (least(node_a, node_b), greatest(node_a, node_b)) FROM M WHERE intensity >= 100)")
def g19(t: Tables) -> DataFrame:
    links = graph.ordered_pair(t.M)
    return links.where("intensity < 100").join(links.where("intensity >= 100").select("u", "v"), ["u", "v"], "left_semi").select("link_label")


@query("g22_triangles", """
WITH p AS (SELECT link_label, length, least(node_a, node_b) AS u, greatest(node_a, node_b) AS v FROM M WHERE node_a <> node_b), e AS (SELECT u, v, link_label, length FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY link_label) AS i FROM p) o WHERE i = 1)
SELECT a.u AS a, a.v AS b, b.v AS c, CASE WHEN (a.length, a.link_label) >= (b.length, b.link_label) AND (a.length, a.link_label) >= (c.length, c.link_label) THEN a.link_label WHEN (b.length, b.link_label) >= (c.length, c.link_label) THEN b.link_label ELSE c.link_label END AS longest
FROM e a JOIN e b ON b.u = a.v JOIN e c ON c.u = a.u AND c.v = b.v""")
def g22(t: Tables) -> DataFrame:
    return graph.triangles(t.M, "length")


@query("g26_label_vote", "SELECT voxel_id, CASE WHEN count(DISTINCT label) OVER (PARTITION BY block_id) = 1 THEN max(label) OVER (PARTITION BY block_id) END AS label FROM (SELECT voxel_id, block_id, CASE WHEN r > 4.9 AND x < 3 THEN y % 3 + 1 END AS label FROM V) s".replace("count(DISTINCT label) OVER (PARTITION BY block_id) = 1", "min(label) OVER (PARTITION BY block_id) = max(label) OVER (PARTITION BY block_id)"))
def g26(t: Tables) -> DataFrame:
    marked = t.V.select("voxel_id", "block_id", F.when((F.col("r") > 4.9) & (F.col("x") < 3), F.col("y") % 3 + 1).alias("label"))
    votes = marked.groupBy("block_id").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return marked.drop("label").join(votes, "block_id").select("voxel_id", F.when(F.col("a") == F.col("b"), F.col("b")).alias("label"))


@query("g27_weighted_voxel_edges", "WITH e AS (SELECT a.voxel_id AS u, b.voxel_id AS v, a.r + b.r AS weight FROM V a JOIN V b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.voxel_id <> b.voxel_id WHERE a.r > 1 AND b.r > 1) SELECT u, v, round(weight, 6) AS weight FROM e")
def g27(t: Tables) -> DataFrame:
    voxels = t.V.where("r > 1")
    r = lambda k: voxels.select(F.col("voxel_id").alias(k), F.col("r").alias(f"r{k}"))
    return spatial.neighbours(voxels, "voxel_id").join(r("u"), "u").join(r("v"), "v").select("u", "v", r6(F.col("ru") + F.col("rv")).alias("weight"))


@query("g28_border_voxels", "WITH s AS (SELECT x, y, z FROM V WHERE r > 4.5), o AS (SELECT unnest([1, -1, 0, 0, 0, 0]) AS dx, unnest([0, 0, 1, -1, 0, 0]) AS dy, unnest([0, 0, 0, 0, 1, -1]) AS dz) SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM s, o WHERE x + dx BETWEEN 1 AND 24 AND y + dy BETWEEN 1 AND 24 AND z + dz >= 1 AND NOT EXISTS (SELECT 1 FROM s q WHERE q.x = s.x + dx AND q.y = s.y + dy AND q.z = s.z + dz)")
def g28(t: Tables) -> DataFrame:
    own = t.V.where("r > 4.5").select("x", "y", "z")
    away = spatial.shifted(own, spatial.FACES).select(*(F.col(f"n{k}").alias(k) for k in "xyz")).distinct()
    return away.where("x BETWEEN 1 AND 24 AND y BETWEEN 1 AND 24 AND z >= 1").join(own, ["x", "y", "z"], "left_anti")


CONTRACT = """
WITH RECURSIVE ends AS (SELECT link_label, unnest([node_a, node_b]) AS node FROM kept), deg AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
j AS (SELECT min(link_label) AS u, max(link_label) AS v FROM ends JOIN deg USING (node) WHERE degree = 2 GROUP BY node), e AS (SELECT u, v FROM j UNION SELECT v, u FROM j),
reach(link_label, root) AS (SELECT link_label, link_label FROM kept UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.link_label), chain AS (SELECT link_label, min(root) AS chain FROM reach GROUP BY 1),
tips AS (SELECT chain, min(node) AS node_a, max(node) AS node_b FROM ends JOIN deg USING (node) JOIN chain USING (link_label) WHERE degree <> 2 GROUP BY chain)
SELECT c.chain AS link_label, tips.node_a AS node_a, tips.node_b AS node_b, round(sum(length), 5) AS length, count(*) AS n_links FROM kept JOIN chain c USING (link_label) LEFT JOIN tips ON tips.chain = c.chain GROUP BY 1, 2, 3"""


@query("r1_delete_and_contract", CONTRACT.replace("WITH RECURSIVE", "WITH RECURSIVE kept AS (SELECT * FROM L WHERE intensity >= 40),"))
def r1(t: Tables) -> DataFrame:
    return graph.contract(t.L.where("intensity >= 40")).withColumn("length", F.round("length", 5))


@query("r3_short_self_loops", "SELECT link_label, n_voxel <= 20 AS deleted FROM M WHERE node_a = node_b")
def r3(t: Tables) -> DataFrame:
    return t.M.where("node_a = node_b").select("link_label", (F.col("n_voxel") <= 20).alias("deleted"))


@query("r4_weak_parallel_links", "WITH p AS (SELECT *, least(node_a, node_b) AS u, greatest(node_a, node_b) AS v FROM M WHERE node_a <> node_b), o AS (SELECT *, count(*) OVER w AS n, min(n_voxel) OVER w AS least, max(n_voxel) OVER w AS most, row_number() OVER (PARTITION BY u, v ORDER BY intensity DESC, link_label) AS i FROM p WINDOW w AS (PARTITION BY u, v)) SELECT link_label FROM o WHERE (n = 2 AND least <= 15 AND i = 2) OR (n >= 3 AND most <= 15 AND i > 1)")
def r4(t: Tables) -> DataFrame:
    w = Window.partitionBy("u", "v")
    rows = graph.ordered_pair(t.M).where("u < v").select("link_label", F.count("*").over(w).alias("n"), F.min("n_voxel").over(w).alias("least"), F.max("n_voxel").over(w).alias("most"), F.row_number().over(w.orderBy(F.desc("intensity"), "link_label")).alias("i"))
    return rows.where("(n = 2 AND least <= 15 AND i = 2) OR (n >= 3 AND most <= 15 AND i > 1)").select("link_label")


@query("r7_merge_nodes", f"WITH RECURSIVE s AS (SELECT * FROM L WHERE length <= 60), {REACH.format(t='s')} SELECT link_label, coalesce(p.component, node_a) AS a, coalesce(q.component, node_b) AS b FROM L LEFT JOIN comp p ON p.node = node_a LEFT JOIN comp q ON q.node = node_b WHERE length > 60")
def r7(t: Tables) -> DataFrame:
    merged = graph.components(graph.both_ways(t.L.where("length <= 60")))
    end = lambda k: merged.select(F.col("node").alias(f"node_{k}"), F.col("component").alias(k))
    rows = t.L.where("length > 60").join(end("a"), "node_a", "left").join(end("b"), "node_b", "left")
    return rows.select("link_label", F.coalesce("a", "node_a").alias("a"), F.coalesce("b", "node_b").alias("b"))


@query("r8_nearby_gap_links", "WITH placed AS (SELECT L.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz FROM L JOIN N p ON p.node = node_a JOIN N q ON q.node = node_b), d AS (SELECT CASE WHEN (a.length, -a.intensity, a.link_label) <= (b.length, -b.intensity, b.link_label) THEN b.link_label ELSE a.link_label END AS loser FROM placed a JOIN placed b ON a.link_label < b.link_label WHERE sqrt(pow(a.ax - b.ax, 2) + pow(a.ay - b.ay, 2) + pow(a.az - b.az, 2)) <= 150 AND sqrt(pow(a.bx - b.bx, 2) + pow(a.by_ - b.by_, 2) + pow(a.bz - b.bz, 2)) <= 150) SELECT link_label FROM placed WHERE link_label NOT IN (SELECT loser FROM d)")
def r8(t: Tables) -> DataFrame:
    """Links without a better one (shorter, then brighter, then of lesser label) whose ends are both within 150 of theirs."""
    rows = placed_links(t).select("link_label", "length", "intensity", *(F.col(f"{s}{k}") for s in "ab" for k in "xyz"))
    losers = spatial.beaten(rows, "link_label", [F.col("length"), -F.col("intensity"), F.col("link_label")], 150)
    return rows.join(losers, "link_label", "left_anti").select("link_label")


@query("r12_repair_nodes", "SELECT node, count(*) AS degree, CASE count(*) WHEN 1 THEN 'endpoint' WHEN 2 THEN 'merged' ELSE 'node' END AS kind FROM (SELECT unnest([node_a, node_b]) AS node FROM L WHERE intensity > 30) e GROUP BY node")
def r12(t: Tables) -> DataFrame:
    ends = t.L.where("intensity > 30").select(F.explode(F.array("node_a", "node_b")).alias("node"))
    counts = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return counts.withColumn("kind", F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") == 2, "merged").otherwise("node"))
