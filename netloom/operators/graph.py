"""Graphs as tables of links (link_label, node_a, node_b) or of edges (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

def both_ways(links: DataFrame, *keep: str) -> DataFrame:
    """Edges u, v in both directions."""
    one = links.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"), *keep)
    return one.unionByName(links.select(F.col("node_b").alias("u"), F.col("node_a").alias("v"), *keep))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of them; edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node reachable, for each node of u, v.

    Large and small stars in turn: edges are hung on the least node around until each node has one
    edge, to its root; about as many rounds as the logarithm of the longest path. Every round is
    checkpointed, and one that changes nothing is the last. A root's edges are many rows of one
    key, but narrow and on the larger side of joins that Spark splits. Null ends are left out.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node IS NOT NULL").distinct()
    state = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = checkpointed(_small_star(_large_star(state)))
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def link_components(links: DataFrame) -> DataFrame:
    """``links`` with component."""
    found = components(links.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")))
    return links.join(found.withColumnRenamed("node", "node_a"), "node_a")


def ordered_pair(links: DataFrame) -> DataFrame:
    return links.withColumn("u", F.least("node_a", "node_b")).withColumn("v", F.greatest("node_a", "node_b"))


def simple_graph(links: DataFrame, weight: str) -> DataFrame:
    """u < v, link_label and weight: no self-loops, of parallel links the first."""
    w = Window.partitionBy("u", "v").orderBy("link_label")
    return ordered_pair(links).where("u < v").withColumn("__r", F.row_number().over(w)).where("__r = 1").select("u", "v", "link_label", weight)


def spread(start: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node`` and ``rank`` by breadth-first search over edges u, v from the nodes of ``start`` (rank 0), up to ``most`` steps."""
    edges = checkpointed(edges.select("u", "v").distinct())
    seen = checkpointed(start.select("node").distinct().withColumn("rank", F.lit(0)))
    front, step = seen, 0
    while most is None or step < most:
        step += 1
        found = front.join(edges, front["node"] == edges["u"]).select(F.col("v").alias("node")).distinct()
        front = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("rank", F.lit(step)))
        if front.isEmpty():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def link_edges(links: DataFrame) -> DataFrame:
    """Links that share a node, as edges u, v between labels."""
    ends = links.select("link_label", F.explode(F.array_distinct(F.array("node_a", "node_b"))).alias("node"))
    return ends.select("node", F.col("link_label").alias("u")).join(ends.select("node", F.col("link_label").alias("v")), "node").where("u <> v").select("u", "v").distinct()


def contract(links: DataFrame, keep: bool = False) -> DataFrame:
    """Chains of links through nodes of degree 2 as one link: label (the least), ends, summed length (and n_voxel), number of links, greatest intensity.

    n_voxel and intensity only with ``keep``, where ``links`` has them. A chain that closes on itself has no free ends: both are null.
    """
    ends = links.select("link_label", F.explode(F.array("node_a", "node_b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    through = ends.join(degree.where("degree = 2").select("node"), "node")
    joins = through.groupBy("node").agg(F.min("link_label").alias("u"), F.max("link_label").alias("v"))
    alone = links.select(F.col("link_label").alias("u"), F.col("link_label").alias("v"))
    chains = components(joins.select("u", "v").unionByName(alone)).select(F.col("node").alias("link_label"), F.col("component").alias("chain"))
    tips = ends.join(degree.where("degree <> 2"), "node").join(chains, "link_label").groupBy("chain").agg(F.min("node").alias("node_a"), F.max("node").alias("node_b"))
    more = [f(c).alias(c) for c, f in (("n_voxel", F.sum), ("intensity", F.max)) if c in links.columns and keep]
    sums = links.join(chains, "link_label").groupBy("chain").agg(F.sum("length").alias("length"), F.count("*").alias("n_links"), *more)
    names = [c for c in ("n_voxel", "intensity") if c in links.columns and keep]
    return sums.join(tips, "chain", "left").select(F.col("chain").alias("link_label"), "node_a", "node_b", "length", "n_links", *names)


def parallel_links(links: DataFrame) -> DataFrame:
    """Node pairs with two or more links: u, v, n, labels ascending, summed length."""
    return ordered_pair(links).where("u < v").groupBy("u", "v").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("link_label")).alias("labels"), F.sum("length").alias("length")).where("n > 1")


def triangles(links: DataFrame, weight: str) -> DataFrame:
    """3-cycles a < b < c of the simple graph with the label of the longest side (of equal ones the greatest)."""
    e = simple_graph(links, weight)
    side = lambda u, v, k: e.select(F.col("u").alias(u), F.col("v").alias(v), F.struct(weight, "link_label").alias(k))
    found = side("a", "b", "s1").join(side("b", "c", "s2"), "b").join(side("a", "c", "s3"), ["a", "c"])
    return found.select("a", "b", "c", F.greatest("s1", "s2", "s3")["link_label"].alias("longest"))
