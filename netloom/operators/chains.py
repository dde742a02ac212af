"""Voxels as a graph: ordered chains of voxels (links) between nodes and free ends.

Tables have voxel_id, x, y, z. A voxel with three or more neighbours is part of a node; one with
one or two lies in a chain. As no chain voxel has more than two neighbours, a chain is a path or
a ring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed
from . import graph, spatial

ROUNDS = 60


def neighbour_counts(voxels: DataFrame) -> DataFrame:
    """``voxels`` with ``n``, the number of its neighbours among 26; written, as all that follows reads it more than once."""
    return checkpointed(spatial.counted(voxels.drop("n")))


def chain_edges(counted: DataFrame) -> DataFrame:
    """Edges u, v between chain voxels, both ways."""
    return spatial.neighbours(counted.where("n IN (1, 2)"), "voxel_id")


def ranked(edges: DataFrame) -> DataFrame:
    """``u``, ``end``, ``steps`` and ``low``: from each voxel of a path, each of its ends that lies another way, how far, and the least voxel on the way.

    Pointer doubling over arcs: an arc u -> v points to the arc that goes on from v, and in each
    round takes over its pointer, so rounds grow with the logarithm of the longest path. Arcs of
    rings never end, so they are told by not having shrunk when all others have ended.
    """
    arcs = checkpointed(edges.select("u", "v"))
    on = arcs.select(F.col("u").alias("v"), F.col("v").alias("w"))
    # of the arcs that leave v, the one that goes back doesn't count; a path's last arc has no other
    state = arcs.join(on, "v", "left").groupBy("u", "v").agg(F.max(F.when(F.col("w") != F.col("u"), F.col("w"))).alias("q"))
    state = checkpointed(state.select("u", "v", F.when(F.col("q").isNotNull(), F.col("v")).alias("p"), "q", F.when(F.col("q").isNull(), F.col("v")).alias("end"), F.lit(1).cast("long").alias("steps"), F.col("v").alias("low")))
    done, state, left = state.where("end IS NOT NULL"), state.where("end IS NULL"), None
    for _ in range(ROUNDS):
        ahead = done.unionByName(state).select(F.col("u").alias("p"), F.col("v").alias("q"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        moved = checkpointed(state.join(ahead, ["p", "q"]).select("u", "v", F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("end2").alias("end"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("low", "low2").alias("low")))
        done, state = done.unionByName(moved.where("end IS NOT NULL")), moved.where("end IS NULL")
        now = state.count()
        if now in (0, left):
            return done.select("u", "end", "steps", "low")
        left = now
    raise RuntimeError(f"paths did not end in {ROUNDS} rounds")


def chains(counted: DataFrame) -> DataFrame:
    """``label``, ``voxel_id``, ``pos`` and ``size`` of each chain voxel.

    label: the least voxel of the chain. pos: from 1 at the end with the smaller id; null in a
    ring, which has no end. A path's label and size follow from its ways to both ends; only rings
    are searched for what hangs together.
    """
    own = counted.where("n IN (1, 2)").select("voxel_id")
    edges = checkpointed(chain_edges(counted))
    far = ranked(edges).withColumnRenamed("u", "voxel_id")
    tips = own.join(edges.groupBy(F.col("u").alias("voxel_id")).agg(F.count("*").alias("k")), "voxel_id", "left").where("k IS NULL OR k = 1")
    ends = far.unionByName(tips.select("voxel_id", F.col("voxel_id").alias("end"), F.lit(0).cast("long").alias("steps"), F.col("voxel_id").alias("low")))
    nearer = F.min(F.struct("end", "steps"))["steps"]
    paths = ends.groupBy("voxel_id").agg((nearer + 1).alias("pos"), (F.sum("steps") + 1).alias("size"), F.min("low").alias("low"))
    paths = checkpointed(paths.select(F.least("low", "voxel_id").alias("label"), "voxel_id", "pos", "size"))
    around = checkpointed(own.join(paths, "voxel_id", "left_anti"))
    if around.isEmpty():
        return paths
    rings = graph.components(edges.join(around.withColumnRenamed("voxel_id", "u"), "u", "left_semi")).select(F.col("component").alias("label"), F.col("node").alias("voxel_id"))
    return paths.unionByName(rings.select("label", "voxel_id", F.lit(None).cast("long").alias("pos"), F.count("*").over(Window.partitionBy("label")).alias("size")))


def node_labels(counted: DataFrame) -> DataFrame:
    """``voxel_id`` and ``node``, the least voxel of its node, for voxels with three or more neighbours."""
    return spatial.touching(counted.where("n > 2"), "voxel_id").select(F.col("node").alias("voxel_id"), F.col("component").alias("node"))


def incidence(voxels: DataFrame) -> DataFrame:
    """``label``, ``size``, ``node_a``, ``node_b`` of each chain that has ends; 0 stands for a free end.

    Two voxels of one node at the same end count once.
    """
    counted = neighbour_counts(voxels)
    return ends_of(counted, checkpointed(chains(counted)))


def ends_of(counted: DataFrame, found: DataFrame) -> DataFrame:
    """incidence() of the chains ``found`` among the voxels ``counted``."""
    touch = spatial.neighbours(counted, "voxel_id").join(node_labels(counted).select(F.col("voxel_id").alias("v"), "node"), "v").select(F.col("u").alias("voxel_id"), "node").distinct()
    ends = found.where("pos = 1 OR pos = size").join(touch, "voxel_id", "left")
    one, last = F.min(F.when(F.col("pos") == 1, F.col("node"))), F.max(F.when(F.col("pos") == F.col("size"), F.col("node")))
    out = ends.groupBy("label", "size").agg(F.coalesce(one, F.lit(0)).alias("node_a"), F.coalesce(last, F.lit(0)).alias("node_b"))
    same = (F.col("size") == 1) & (F.col("node_a") == F.col("node_b"))
    return out.withColumn("node_b", F.when(same, 0).otherwise(F.col("node_b")))


def prune_hairs(voxels: DataFrame, most: int, rounds: int = 50) -> DataFrame:
    """``voxels`` without chains of at most ``most`` voxels that have one free end and hang on a node; repeated until there is none."""
    left = voxels
    for _ in range(rounds):
        counted = neighbour_counts(left)
        found = chains(counted).where(F.col("size") <= most).join(counted.select("voxel_id", "n"), "voxel_id")
        touch = spatial.neighbours(counted, "voxel_id").join(counted.where("n > 2").select(F.col("voxel_id").alias("v")), "v").select(F.col("u").alias("voxel_id")).distinct().withColumn("at_node", F.lit(1))
        hairs = found.join(touch, "voxel_id", "left").groupBy("label").agg(F.count(F.when(F.col("n") == 1, 1)).alias("free"), F.count("at_node").alias("held")).where("free = 1 AND held > 0")
        gone = checkpointed(found.join(hairs, "label", "left_semi").select("voxel_id"))
        if gone.isEmpty():
            return left
        left = checkpointed(left.join(gone, "voxel_id", "left_anti"))
    raise RuntimeError(f"hairs were left after {rounds} rounds")
