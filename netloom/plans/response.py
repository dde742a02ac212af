"""Queries: what happens to the space around a link when it is removed.

The mask is the wide voxels, as links, rings and nodes (chains.py). A cell belongs to its nearest
mask voxel's label; without that label it goes to the second nearest one, so one search for two
labels answers the removal of every link. The link's own voxels become cells, too. Nodes are
labels below zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, paths, spatial, stats
from ..sources.scratch import checkpointed
from .chains import NODES, chain_sql
from .coordinates import r6
from .registry import Tables, query

D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
#: Wide and thin voxels, and how far around a new maximum has to be the greatest.
MASK, CELLS, WINDOW = "r >= 4", "r < 1", 2


def labelled_mask(voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mask voxels (x, y, z, label; links and rings above zero, nodes below) and the links' incidence."""
    counted = chains.neighbour_counts(voxels.select("voxel_id", "x", "y", "z"))
    own = chains.chains(counted).select("voxel_id", "label").unionByName(chains.node_labels(counted).select("voxel_id", (-F.col("node")).alias("label")))
    return checkpointed(own.join(counted, "voxel_id").select("x", "y", "z", "label")), checkpointed(chains.incidence(voxels.select("voxel_id", "x", "y", "z")))


def removal(cells: DataFrame, mask: DataFrame, radius: float = 4) -> DataFrame:
    """x, y, z, own (whether the place is the link's), label, before, taker, after: of each cell and mask voxel whose label is a link."""
    points = cells.select("x", "y", "z").distinct().unionByName(mask.select("x", "y", "z"))
    two = checkpointed(spatial.k_nearest(points, mask, "label", 2, radius))
    first = two.where("place = 1 AND label > 0").select("x", "y", "z", (F.col("distance") == 0).alias("own"), "label", F.col("distance").alias("before"))
    second = two.where("place = 2").select("x", "y", "z", F.col("label").alias("taker"), F.col("distance").alias("after"))
    return first.join(second, ["x", "y", "z"], "left")


def taker_shares(rows: DataFrame, incidence: DataFrame) -> DataFrame:
    """label, taker and share of the space that links take over; a node's cells are shared out evenly among its links that take some themselves."""
    counts = checkpointed(rows.where("taker IS NOT NULL").groupBy("label", "taker").agg(F.count("*").cast("double").alias("n")))
    links = counts.where("taker > 0")
    held = incidence.select(F.col("label").alias("other"), F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node")).where("node > 0")
    nodes = counts.where("taker < 0").select("label", (-F.col("taker")).alias("node"), F.col("n").alias("given"))
    reached = nodes.join(held, "node").where("other <> label").join(links.select("label", F.col("taker").alias("other")), ["label", "other"])
    parts = reached.join(reached.groupBy("label", "node").agg(F.count("*").alias("k")), ["label", "node"]).groupBy("label", F.col("other").alias("taker")).agg(F.sum(F.col("given") / F.col("k")).alias("more"))
    sizes = links.join(parts, ["label", "taker"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0.0)))
    return sizes.join(sizes.groupBy("label").agg(F.sum("n").alias("all")), "label").select("label", "taker", (F.col("n") / F.col("all")).alias("share"))


def taker_orders(pairs: DataFrame, incidence: DataFrame) -> DataFrame:
    """label, taker and branch order: 1 where both links share a node, one more for each link between; null where no path joins them."""
    ends = incidence.select("label", F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node")).where("node > 0")
    goals = checkpointed(pairs.select("label", "taker").join(ends.select(F.col("label").alias("taker"), F.col("node").alias("goal")), "taker"))
    edges = incidence.where("node_a > 0 AND node_b > 0").select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    starts = ends.join(pairs.select("label").distinct(), "label").select(F.col("label").alias("search"), "node")
    found = paths.hops_between(starts, goals.select(F.col("label").alias("search"), "goal"), both)
    near = goals.join(found.withColumnRenamed("search", "label"), ["label", "goal"]).groupBy("label", "taker").agg((F.min("hops") + 1).alias("branch_order"))
    return pairs.join(near, ["label", "taker"], "left")


LINKS = NODES.replace("\nSELECT label, size, node_a, CASE", ",\nlk AS MATERIALIZED (SELECT label, size, node_a, CASE")
SPACE = f"""{chain_sql(f'(SELECT * FROM V WHERE {MASK}) s')}, rest AS MATERIALIZED (SELECT voxel_id FROM cls WHERE n = 2 AND voxel_id NOT IN (SELECT voxel_id FROM link)), rr(voxel_id, root) AS (SELECT voxel_id, voxel_id FROM rest UNION SELECT ce.v, rr.root FROM rr JOIN ce ON ce.u = rr.voxel_id),
{LINKS}),
mask AS MATERIALIZED (SELECT x, y, z, label FROM cls JOIN (SELECT voxel_id, label FROM link UNION ALL SELECT voxel_id, min(root) FROM rr GROUP BY 1 UNION ALL SELECT voxel_id, -node FROM nodes) l USING (voxel_id)),
pt AS (SELECT x, y, z FROM V WHERE {CELLS} UNION ALL SELECT x, y, z FROM mask), dist AS (SELECT a.x, a.y, a.z, b.label, min({D3}) AS d FROM pt a, mask b GROUP BY 1, 2, 3, 4),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY d, label) AS i FROM dist QUALIFY i <= 2),
p AS MATERIALIZED (SELECT a.x, a.y, a.z, a.d = 0 AS own, a.label, a.d AS before, b.label AS taker, b.d AS after FROM rk a LEFT JOIN rk b ON b.x = a.x AND b.y = a.y AND b.z = a.z AND b.i = 2 WHERE a.i = 1 AND a.label > 0),
face AS (SELECT label FROM p, (SELECT min(z) AS z0, max(z) AS z1 FROM V) e WHERE NOT own AND (x IN (1, 24) OR y IN (1, 24) OR z IN (z0, z1)) GROUP BY label)"""


def off_faces(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows of labels without a cell on the volume's faces."""
    ends = t.V.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))  # one row
    face = rows.where("NOT own").crossJoin(F.broadcast(ends)).where("x IN (1, 24) OR y IN (1, 24) OR z IN (z0, z1)")
    return rows.join(face.select("label").distinct(), "label", "left_anti")


def own_gap(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (label, x, y, z) with gap, the distance to the nearest voxel of their link."""
    own = links.where("own").select("label", *(F.col(k).alias(f"s{k}") for k in "xyz"))
    gap = F.sqrt(sum((F.pow((F.col(k) - F.col(f"s{k}")).cast("double"), F.lit(2.0)) for k in "xyz"), F.lit(0.0)))
    return rows.join(own, "label").groupBy(*rows.columns).agg(F.min(gap).alias("gap"))


@query("f18_removal_response", f"""{SPACE}, w AS MATERIALIZED (SELECT * FROM p WHERE label NOT IN (SELECT label FROM face)), c AS (SELECT label, taker, count(*)::DOUBLE AS n FROM w WHERE taker IS NOT NULL GROUP BY 1, 2), inci AS (SELECT label, node_a AS node FROM lk WHERE node_a > 0 UNION SELECT label, node_b FROM lk WHERE node_b > 0),
rc AS (SELECT c.label, -c.taker AS node, c.n, h.label AS other FROM c JOIN inci h ON h.node = -c.taker AND h.label <> c.label JOIN c k ON k.label = c.label AND k.taker = h.label), gv AS (SELECT label, other AS taker, sum(n / k) AS more FROM (SELECT *, count(*) OVER (PARTITION BY label, node) AS k FROM rc) q GROUP BY 1, 2),
sz AS (SELECT label, taker, n + coalesce(more, 0) AS n FROM c LEFT JOIN gv USING (label, taker) WHERE taker > 0), sh AS MATERIALIZED (SELECT label, taker, n / sum(n) OVER (PARTITION BY label) AS share FROM sz),
ge AS (SELECT node_a AS u, node_b AS v FROM lk WHERE node_a > 0 AND node_b > 0 UNION SELECT node_b, node_a FROM lk WHERE node_a > 0 AND node_b > 0),
bf(search, node, hops) USING KEY (search, node) AS (SELECT DISTINCT inci.label, node, 0 FROM inci JOIN sh USING (label) UNION (SELECT bf.search, ge.v, min(bf.hops + 1) FROM bf JOIN ge ON ge.u = bf.node LEFT JOIN recurring.bf r ON r.search = bf.search AND r.node = ge.v WHERE r.search IS NULL GROUP BY 1, 2)),
od AS (SELECT sh.label, sh.taker, min(hops) + 1 AS o FROM sh JOIN inci ON inci.label = sh.taker JOIN bf ON bf.search = sh.label AND bf.node = inci.node GROUP BY 1, 2),
tk AS (SELECT label, count(*) AS takers, max(share) AS largest, arg_max(o, struct_pack(s := round(share, 9), t := -taker)) AS largest_order, max(o) AS most_order, arg_max(share, struct_pack(o := o, t := -taker)) FILTER (o IS NOT NULL) AS most_order_share, sum(share) FILTER (o = 1) AS first_order_share FROM sh LEFT JOIN od USING (label, taker) GROUP BY label),
far AS (SELECT a.label, min({D3}) AS gap FROM w a JOIN (SELECT label, max(after) AS m FROM w GROUP BY 1) g ON g.label = a.label AND g.m = a.after JOIN w b ON b.label = a.label AND b.own GROUP BY 1),
s AS (SELECT label, count(*) FILTER (own) AS n_own, count(*) FILTER (NOT own) AS volume, avg(before) FILTER (NOT own) AS mean_before, max(before) FILTER (NOT own) AS most_before, avg(after - before) FILTER (NOT own) AS mean_change, avg(before / after) FILTER (NOT own) AS mean_ratio, avg(after) AS mean_after, max(after) AS most_after, median(after) AS median_after, avg(after) FILTER (own) AS own_mean, median(after) FILTER (own) AS own_median, max(after) FILTER (own) AS own_most FROM w GROUP BY label)
SELECT label, n_own, volume, {', '.join(f'round({k}, 6) AS {k}' for k in ('mean_before', 'most_before', 'mean_change', 'mean_ratio', 'mean_after', 'most_after', 'median_after', 'own_mean', 'own_median', 'own_most'))}, round(gap, 6) AS most_after_gap, coalesce(takers, 0) AS takers, round(largest, 6) AS largest_share, largest_order, most_order, round(most_order_share, 6) AS most_order_share, round(first_order_share, 6) AS first_order_share FROM s LEFT JOIN far USING (label) LEFT JOIN tk USING (label) WHERE volume > 0""")
def f18(t: Tables) -> DataFrame:
    """Removal of each link whose region touches no face: distances of its cells and own voxels before and after, who takes them over, and the takers' branch orders.

    Of equal shares or orders the least taker counts. Without any other label the later distances and takers are null.
    """
    mask, incidence = labelled_mask(t.V.where(MASK))
    rows = checkpointed(off_faces(t, checkpointed(removal(t.V.where(CELLS), mask))))
    given = ~F.col("own")
    at = lambda f, c, w=None: f(F.when(w, c)) if w is not None else f(c)
    after, before = F.col("after"), F.col("before")
    sums = rows.groupBy("label").agg(
        F.count(F.when(F.col("own"), 1)).alias("n_own"), F.count(F.when(given, 1)).alias("volume"), at(F.avg, before, given).alias("mean_before"), at(F.max, before, given).alias("most_before"), at(F.avg, after - before, given).alias("mean_change"),
        at(F.avg, before / after, given).alias("mean_ratio"), F.avg(after).alias("mean_after"), F.max(after).alias("most_after"), at(F.avg, after, F.col("own")).alias("own_mean"), at(F.max, after, F.col("own")).alias("own_most"),
    ).where("volume > 0")
    median = lambda df, name: stats.midpoint_percentiles(df.where("after IS NOT NULL"), ["label"], "after", (50,)).select("label", F.col("percentile").alias(name))
    farthest = rows.join(rows.groupBy("label").agg(F.max("after").alias("m")), "label").where("after = m").select("label", "x", "y", "z")
    gaps = own_gap(farthest, rows).groupBy("label").agg(F.min("gap").alias("most_after_gap"))
    shares = checkpointed(taker_shares(rows, incidence))
    orders = checkpointed(taker_orders(shares, incidence))
    first = lambda c, *order: F.max_by(c, F.struct(*order, -F.col("taker")))
    takers = orders.groupBy("label").agg(
        F.count("*").alias("takers"), F.max("share").alias("largest_share"), first("branch_order", F.round("share", 9)).alias("largest_order"), F.max("branch_order").alias("most_order"),
        F.max_by(F.when(F.col("branch_order").isNotNull(), F.col("share")), F.when(F.col("branch_order").isNotNull(), F.struct("branch_order", -F.col("taker")))).alias("most_order_share"), F.sum(F.when(F.col("branch_order") == 1, F.col("share"))).alias("first_order_share"),
    )
    out = sums.join(median(rows, "median_after"), "label", "left").join(median(rows.where("own"), "own_median"), "label", "left").join(gaps, "label", "left").join(takers, "label", "left")
    plain = ("mean_before", "most_before", "mean_change", "mean_ratio", "mean_after", "most_after", "median_after", "own_mean", "own_median", "own_most", "most_after_gap")
    return out.select("label", "n_own", "volume", *(r6(F.col(k)).alias(k) for k in plain), F.coalesce("takers", F.lit(0)).alias("takers"), r6(F.col("largest_share")).alias("largest_share"), "largest_order", "most_order", r6(F.col("most_order_share")).alias("most_order_share"), r6(F.col("first_order_share")).alias("first_order_share"))


@query("f19_local_maximum_response", f"""{SPACE}, w AS MATERIALIZED (SELECT * FROM p WHERE label NOT IN (SELECT label FROM face) AND after IS NOT NULL), old AS MATERIALIZED (SELECT x, y, z, label, d FROM rk WHERE i = 1),
m AS (SELECT * FROM w a WHERE NOT EXISTS (SELECT 1 FROM old b WHERE abs(a.x - b.x) <= {WINDOW} AND abs(a.y - b.y) <= {WINDOW} AND b.z BETWEEN a.z - {WINDOW} AND a.z + {WINDOW} AND b.label <> a.label AND b.d > a.after)
 AND NOT EXISTS (SELECT 1 FROM w b WHERE abs(a.x - b.x) <= {WINDOW} AND abs(a.y - b.y) <= {WINDOW} AND b.z BETWEEN a.z - {WINDOW} AND a.z + {WINDOW} AND b.label = a.label AND b.after > a.after)),
g AS (SELECT a.label, a.after, min({D3}) AS gap FROM m a JOIN w b ON b.label = a.label AND b.own GROUP BY a.label, a.x, a.y, a.z, a.after), k AS (SELECT label, count(*) AS maxima, min(struct_pack(d := gap, v := -after)) AS q FROM g GROUP BY label)
SELECT label, maxima, round(q.d, 6) AS distance, round(-q.v, 6) AS value FROM k""")
def f19(t: Tables) -> DataFrame:
    """After removal of a link: how many places of its space are local maxima of the distance then, which is nearest to the link (of equally near ones the greatest), and its value.

    A place is compared with all places within the window: those of the same link after removal, others as they are.
    """
    mask, _ = labelled_mask(t.V.where(MASK))
    cells = t.V.where(CELLS)
    rows = checkpointed(off_faces(t, checkpointed(removal(cells, mask))).where("after IS NOT NULL"))
    points = cells.select("x", "y", "z").distinct().unionByName(mask.select("x", "y", "z"))
    old = checkpointed(spatial.k_nearest(points, mask, "label", 1, 4).select("x", "y", "z", F.col("label").alias("holder"), F.col("distance").alias("value")))
    box = [(i, j, k) for i in range(-WINDOW, WINDOW + 1) for j in range(-WINDOW, WINDOW + 1) for k in range(-WINDOW, WINDOW + 1) if any((i, j, k))]
    around = spatial.shifted(rows.select("label", "x", "y", "z", "after"), box)
    of = lambda df, *more: df.select(*(F.col(k).alias(f"n{k}") for k in "xyz"), *more)
    others = around.join(of(old, "holder", "value"), ["nx", "ny", "nz"]).where("holder <> label AND value > after")
    same = around.join(of(rows, "label", F.col("after").alias("value")), ["label", "nx", "ny", "nz"]).where("value > after")
    higher = others.select("label", "x", "y", "z").unionByName(same.select("label", "x", "y", "z")).distinct()
    maxima = rows.join(higher, ["label", "x", "y", "z"], "left_anti").select("label", "x", "y", "z", "after")
    best = own_gap(maxima, rows).groupBy("label").agg(F.count("*").alias("maxima"), F.min(F.struct("gap", (-F.col("after")).alias("v"))).alias("q"))
    return best.select("label", "maxima", r6(F.col("q.gap")).alias("distance"), r6(-F.col("q.v")).alias("value"))
