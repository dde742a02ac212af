"""Queries: voxel chains as links (G4, G5, G18, G20, G24, F1) and their refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, spatial
from .coordinates import r6
from .registry import Tables, query

BOX = "x BETWEEN 2 AND 23 AND y BETWEEN 2 AND 23"


def chain_sql(source: str) -> str:
    """Common table expressions: vox, adj, cls, ce (chain edges), walk, ends and link (label, voxel_id, pos, size) of the voxels of ``source``."""
    return f"""WITH RECURSIVE vox AS MATERIALIZED (SELECT * FROM {source}),
adj AS MATERIALIZED (SELECT a.voxel_id AS u, b.voxel_id AS v FROM vox a JOIN vox b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.voxel_id <> b.voxel_id),
cls AS MATERIALIZED (SELECT vox.voxel_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, count(v) AS n FROM vox LEFT JOIN adj ON u = voxel_id GROUP BY voxel_id),
ce AS MATERIALIZED (SELECT u, v FROM adj JOIN cls p ON p.voxel_id = u AND p.n <= 2 JOIN cls q ON q.voxel_id = v AND q.n <= 2),
tip AS (SELECT voxel_id FROM cls LEFT JOIN ce ON u = voxel_id WHERE n IN (1, 2) GROUP BY voxel_id HAVING count(v) <= 1),
walk(s, prev, voxel_id, pos) AS (SELECT voxel_id, 0::BIGINT, voxel_id, 1 FROM tip UNION ALL SELECT s, walk.voxel_id, ce.v, pos + 1 FROM walk JOIN ce ON ce.u = walk.voxel_id AND ce.v <> walk.prev),
ends AS (SELECT s, count(*) AS size, arg_max(voxel_id, pos) AS e, min(voxel_id) AS label FROM walk GROUP BY s),
link AS MATERIALIZED (SELECT label, voxel_id, pos, size FROM walk JOIN ends USING (s) WHERE s <= e)"""


NODES = """ne AS MATERIALIZED (SELECT u, v FROM adj JOIN cls p ON p.voxel_id = u AND p.n > 2 JOIN cls q ON q.voxel_id = v AND q.n > 2),
nr(voxel_id, root) AS (SELECT voxel_id, voxel_id FROM cls WHERE n > 2 UNION SELECT ne.v, nr.root FROM nr JOIN ne ON ne.u = nr.voxel_id),
nodes AS (SELECT voxel_id, min(root) AS node FROM nr GROUP BY voxel_id),
touch AS (SELECT DISTINCT u AS voxel_id, node FROM adj JOIN nodes ON nodes.voxel_id = v),
inc AS (SELECT label, size, coalesce(min(node) FILTER (pos = 1), 0) AS node_a, coalesce(max(node) FILTER (pos = size), 0) AS node_b FROM link LEFT JOIN touch USING (voxel_id) WHERE pos = 1 OR pos = size GROUP BY label, size)
SELECT label, size, node_a, CASE WHEN size = 1 AND node_a = node_b THEN 0 ELSE node_b END AS node_b FROM inc"""


def linked(voxels: DataFrame) -> DataFrame:
    """Chain voxels with label, pos, size, their place and neighbour count."""
    counted = chains.neighbour_counts(voxels)
    return chains.chains(counted).join(counted.select("voxel_id", "x", "y", "z", "n"), "voxel_id")


@query("g4_link_components", f"{chain_sql('V')}, rest AS MATERIALIZED (SELECT voxel_id FROM cls WHERE n = 2 AND voxel_id NOT IN (SELECT voxel_id FROM link)), rr(voxel_id, root) AS (SELECT voxel_id, voxel_id FROM rest UNION SELECT ce.v, rr.root FROM rr JOIN ce ON ce.u = rr.voxel_id), ring AS (SELECT voxel_id, min(root) AS label FROM rr GROUP BY 1) SELECT label, voxel_id, pos, size FROM link UNION ALL SELECT label, voxel_id, NULL, count(*) OVER (PARTITION BY label) FROM ring")
def g4(t: Tables) -> DataFrame:
    return chains.chains(chains.neighbour_counts(t.V))


@query("g5_link_node_incidence", f"{chain_sql('V')}, {NODES}")
def g5(t: Tables) -> DataFrame:
    return chains.incidence(t.V)


@query("g18_endpoint_links", f"{chain_sql('V')} SELECT label, count(*) AS n_voxel, count(*) FILTER (n = 1 AND {BOX}) AS n_free FROM link JOIN cls USING (voxel_id) GROUP BY label HAVING count(*) FILTER (n = 1 AND {BOX}) > 0")
def g18(t: Tables) -> DataFrame:
    free = F.count(F.when(F.expr(f"n = 1 AND {BOX}"), 1))
    return linked(t.V).groupBy("label").agg(F.count("*").alias("n_voxel"), free.alias("n_free")).where("n_free > 0")


MERGED = "SELECT DISTINCT V.voxel_id, V.x, V.y, V.z FROM V JOIN (SELECT DISTINCT block_id AS b FROM V) blocks ON V.z BETWEEN 24 * b + 1 - 4 AND 24 * b + 24 + 4 WHERE V.z BETWEEN CASE WHEN b - 1 IN (SELECT block_id FROM V) THEN 24 * b + 1 ELSE 24 * b + 1 - 4 END AND CASE WHEN b + 1 IN (SELECT block_id FROM V) THEN 24 * b + 24 ELSE 24 * b + 24 + 4 END"


@query("g20_merged_blocks", f"{chain_sql(f'({MERGED}) s')} SELECT label, count(*) AS n_voxel FROM link GROUP BY label")
def g20(t: Tables) -> DataFrame:
    """Blocks overlap by eight layers; where a neighbour exists a block gives up its half, then the union is built anew."""
    copies = t.V.select("voxel_id", "x", "y", "z", F.explode(F.array(F.col("block_id") - 1, F.col("block_id"), F.col("block_id") + 1)).alias("b"))
    has = t.V.select("block_id").distinct()
    at = lambda d, name: has.select((F.col("block_id") + d).alias("b"), F.lit(4).alias(name))
    blocks = has.select(F.col("block_id").alias("b")).join(at(1, "below"), "b", "left").join(at(-1, "above"), "b", "left")
    inside = copies.join(blocks, "b").where("z >= 24 * b - 3 + coalesce(below, 0) AND z <= 24 * b + 28 - coalesce(above, 0)")
    merged = inside.select("voxel_id", "x", "y", "z").distinct()
    return chains.chains(chains.neighbour_counts(merged)).where("pos IS NOT NULL").groupBy("label").agg(F.count("*").alias("n_voxel"))


D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("g24_branch_proximity", f"{chain_sql('V')}, placed AS MATERIALIZED (SELECT label, pos, size, x, y, z FROM link JOIN cls USING (voxel_id)) SELECT a.label AS branch, b.label AS other, round(min({D3}), 6) AS distance FROM placed a JOIN placed b ON a.label <> b.label AND b.z BETWEEN a.z - 3 AND a.z + 3 AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 WHERE (a.pos = 1 OR a.pos = a.size) AND {D3} <= 3 GROUP BY 1, 2")
def g24(t: Tables) -> DataFrame:
    placed = linked(t.V).where("pos IS NOT NULL").select("label", "pos", "size", "x", "y", "z")
    near = spatial.within(placed.where("pos = 1 OR pos = size"), placed.select("label", "x", "y", "z"), 3).where("a.label <> b.label")
    return near.groupBy(F.col("a.label").alias("branch"), F.col("b.label").alias("other")).agg(r6(F.min("distance")).alias("distance"))


@query("f1_link_length", f"{chain_sql('V')}, placed AS MATERIALIZED (SELECT label, pos, x, y, z FROM link JOIN cls USING (voxel_id)) SELECT a.label, round(1 + coalesce(sum({D3}), 0), 6) AS length FROM placed a LEFT JOIN placed b ON a.label = b.label AND b.pos = a.pos + 1 GROUP BY a.label")
def f1(t: Tables) -> DataFrame:
    """Steps between neighbouring voxels of the chain and one voxel; needs no order."""
    placed = linked(t.V).where("pos IS NOT NULL").select("label", "voxel_id", "pos", "x", "y", "z")
    step = placed.select("label", (F.col("pos") - 1).alias("pos"), *(F.col(k).alias(f"b{k}") for k in "xyz"))
    gap = F.sqrt(sum((F.pow((F.col(f"b{k}") - F.col(k)).cast("double"), F.lit(2.0)) for k in "xyz"), F.lit(0.0)))
    return placed.join(step, ["label", "pos"], "left").groupBy("label").agg(r6(1 + F.coalesce(F.sum(gap), F.lit(0.0))).alias("length"))


@query("r2_short_hairs")
def r2(t: Tables) -> DataFrame:
    return chains.prune_hairs(t.V.select("voxel_id", "x", "y", "z"), 5)


@query("r6_new_loose_links", f"{chain_sql('(SELECT * FROM V WHERE r >= 0.6) s')}, old AS (SELECT a.voxel_id FROM V a JOIN V b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND a.voxel_id <> b.voxel_id GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT label, size FROM link JOIN cls USING (voxel_id) WHERE n = 1 AND size <= 5 AND voxel_id NOT IN (SELECT voxel_id FROM old)")
def r6_new(t: Tables) -> DataFrame:
    old = chains.neighbour_counts(t.V).where("n = 1").select("voxel_id")
    found = linked(t.V.where("r >= 0.6")).where("n = 1 AND size <= 5 AND pos IS NOT NULL")
    return found.join(old, "voxel_id", "left_anti").select("label", "size").distinct()


@query("r10_added_links", f"{chain_sql('(SELECT * FROM V WHERE r < 3 UNION SELECT * FROM V WHERE r >= 4 AND x < 20) s')}, {NODES}")
def r10(t: Tables) -> DataFrame:
    """The graph of the voxels of a graph and of added links together."""
    both = t.V.where("r < 3").unionByName(t.V.where("r >= 4 AND x < 20")).select("voxel_id", "x", "y", "z").distinct()
    return chains.incidence(both)
