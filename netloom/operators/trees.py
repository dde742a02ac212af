"""Rooted trees (tree, id, x, y, z, r, parent): branches, pruning, sampling, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

ROUNDS = 64


def with_steps(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``step``, the distance to the parent (roots: 0), and ``children``."""
    up = nodes.select("tree", F.col("id").alias("parent"), *(F.col(k).alias(f"p{k}") for k in "xyz"))
    counts = nodes.where("parent > 0").groupBy("tree", F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    gap = F.sqrt(sum((F.pow(F.col(k) - F.col(f"p{k}"), F.lit(2)) for k in "xyz"), F.lit(0.0)))
    joined = nodes.join(up, ["tree", "parent"], "left").join(counts, ["tree", "id"], "left")
    return joined.select(*nodes.columns, F.coalesce(gap, F.lit(0.0)).alias("step"), F.coalesce("children", F.lit(0)).alias("children"))


def branches(nodes: DataFrame) -> DataFrame:
    """Each node with ``branch``, the critical node (root, fork or leaf) that ends its branch, ``along``, the way from there, and ``rank``.

    Pointers double: a node of one child points to that child until all point at critical nodes.
    """
    stepped = with_steps(nodes)
    critical = (F.col("children") != 1) | (F.col("parent") <= 0)
    child = nodes.where("parent > 0").select("tree", F.col("parent").alias("id"), F.col("id").alias("child"))
    down = stepped.select("tree", F.col("id").alias("child"), F.col("step").alias("child_step"))
    inner = stepped.where(~critical).select("tree", "id").join(child, ["tree", "id"]).join(down, ["tree", "child"]).select("tree", "id", F.col("child").alias("to"), F.col("child_step").alias("along"), F.lit(1).alias("rank"))
    state = checkpointed(stepped.where(critical).select("tree", "id", F.col("id").alias("to"), F.lit(0.0).alias("along"), F.lit(0).alias("rank")).unionByName(inner))
    before = None
    for _ in range(ROUNDS):
        far = state.select("tree", F.col("id").alias("to"), F.col("to").alias("far"), F.col("along").alias("more"), F.col("rank").alias("ranks"))
        state = checkpointed(state.join(far, ["tree", "to"]).select("tree", "id", F.col("far").alias("to"), (F.col("along") + F.col("more")).alias("along"), (F.col("rank") + F.col("ranks")).alias("rank")))
        now = state.agg(F.sum("rank")).first()[0]
        if now == before:
            break
        before = now
    return stepped.join(state.withColumnRenamed("to", "branch"), ["tree", "id"])


def branch_table(nodes: DataFrame) -> DataFrame:
    """One row a branch: its end, number of nodes, length with the link to the parent branch, whether a leaf ends it, parent branch."""
    marked = branches(nodes)
    top = marked.groupBy("tree", "branch").agg(F.count("*").alias("n"), F.sum("step").alias("length"), F.max(F.when(F.col("id") == F.col("branch"), F.col("children"))).alias("children"), F.max_by("parent", "rank").alias("above"))
    over = marked.select("tree", F.col("id").alias("above"), F.col("branch").alias("parent_branch"))
    return top.join(over, ["tree", "above"], "left").select("tree", "branch", "n", "length", (F.col("children") == 0).alias("leaf"), "parent_branch")


def prune_leaves(nodes: DataFrame, least: float) -> DataFrame:
    """``nodes`` without leaf branches shorter than ``least``."""
    short = branch_table(nodes).where(F.col("leaf") & (F.col("length") < least) & F.col("parent_branch").isNotNull()).select("tree", "branch")
    return branches(nodes).join(short, ["tree", "branch"], "left_anti").select(*nodes.columns)


def downsample(nodes: DataFrame, spacing: float) -> DataFrame:
    """Critical nodes, and of each branch the first node in every ``spacing`` along it."""
    w = Window.partitionBy("tree", "branch").orderBy("along", "id")
    marked = branches(nodes).withColumn("cell", F.floor(F.round("along", 9) / spacing)).withColumn("before", F.lag("cell").over(w))
    return marked.where((F.col("id") == F.col("branch")) | (F.col("cell") > F.col("before"))).select(*nodes.columns)


def upsample(nodes: DataFrame, spacing: float) -> DataFrame:
    """Points every ``spacing`` along each edge from the parent, and the node itself: tree, id, at, x, y, z."""
    up = nodes.select("tree", F.col("id").alias("parent"), *(F.col(k).alias(f"p{k}") for k in "xyz"))
    edges = with_steps(nodes).join(up, ["tree", "parent"]).where("step > 0")
    rows = edges.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("step") / spacing))))
    at = F.least(F.col("k") * spacing, F.col("step"))
    return rows.select("tree", "id", at.alias("at"), *((F.col(f"p{k}") + (F.col(k) - F.col(f"p{k}")) * at / F.col("step")).alias(k) for k in "xyz"))


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def smooth(nodes: DataFrame, axes: Sequence[str] = ("x", "y", "z"), width: int = 5) -> DataFrame:
    """Inner nodes' coordinates replaced by the moving median along the branch, applied twice."""
    marked = branches(nodes)
    half = width // 2
    for _ in range(2):
        w = Window.partitionBy("tree", "branch").orderBy("rank", "id").rowsBetween(-half, half)
        inner = F.col("id") != F.col("branch")
        medians = {k: F.when(inner, _middle(F.array_sort(F.collect_list(k).over(w)))).otherwise(F.col(k)) for k in axes}
        marked = marked.withColumns(medians)
    return marked.select(*nodes.columns)
