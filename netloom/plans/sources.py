"""Queries: sources and sinks (S), learning tables (L), trees (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, trees
from ..sources import files
from ..sources.scratch import checkpointed
from .coordinates import r6
from .registry import Tables, query


@query("s2_gather_blocks", "SELECT voxel_id, z - 24 AS local_z FROM V WHERE block_id BETWEEN 1 AND 2")
def s2(t: Tables) -> DataFrame:
    blocks = t.V.withColumns({"idx_1": F.lit(1), "idx_2": F.lit(1), "layer": F.col("block_id")})
    return files.gather_blocks(blocks, (1, 1), (1, 1), (1, 2)).select("voxel_id", (F.col("z") - 24).alias("local_z"))


@query("s4_finite_rows", "SELECT link_label, length, CASE WHEN vx <> 0 THEN r / vx END AS ratio FROM C WHERE vx <> 0")
def s4(t: Tables) -> DataFrame:
    rows = t.C.select("link_label", "length", F.when(F.col("vx") != 0, F.col("r") / F.col("vx")).alias("ratio"))
    return files.finite_rows(rows)


@query("s8_missing_outputs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def s8(t: Tables) -> DataFrame:
    return files.missing_outputs(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("l1_training_rows", "SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS label, CASE WHEN toxic = 1 THEN 'artefact' WHEN doc_id % 10 = 0 THEN 'unsure' ELSE 'normal' END AS part FROM labels")
def l1(t: Tables) -> DataFrame:
    return learning.training_rows(t.labels, F.col("quality") == 0, F.col("doc_id") % 10 == 0, F.col("toxic") == 1).select("doc_id", "label", "part")


@query("l2_balanced_split", "WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR || '|7'), doc_id) AS i FROM labels), m AS (SELECT round(0.5 * min(n)) AS t FROM (SELECT count(*) AS n FROM labels GROUP BY quality) c) SELECT doc_id, i <= t AS train FROM o, m")
def l2(t: Tables) -> DataFrame:
    return learning.hashed_split(t.labels, "doc_id", "quality", 0.5, 7, balance=True).select("doc_id", "train")


@query("l3_l4_train_and_score")
def l3(t: Tables) -> DataFrame:
    rows = t.C.withColumn("label", (F.col("r") > 2.5).cast("int"))
    split = checkpointed(learning.hashed_split(rows, "link_label", "label", 0.5, 7).select("link_label", "label", "length", "r", "vx", "vy", "vz", "train"))  # fitting and scoring read it
    model = learning.train(split.where("train"), ["length", "r", "vx", "vy", "vz"], kind="boosted")
    return learning.score(model, split.where("NOT train")).select("link_label", "label", "prediction")


@query("l5_validation_statistics", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (toxic = 1), 6) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 1) / count(*) FILTER (quality = 1), 6) AS recall, round(count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (toxic = 1), 6) AS false_rate FROM labels")
def l5(t: Tables) -> DataFrame:
    out = learning.validation(t.labels, F.col("quality"), F.col("toxic"))
    return out.select("tp", "tn", "fp", "fn", *(r6(F.col(k)).alias(k) for k in ("precision", "recall", "false_rate")))


@query("l6_hashed_folds", "SELECT doc_id, CAST('0x' || substr(md5(doc_id::VARCHAR || '|7'), 1, 8) AS BIGINT) % 5 AS fold FROM labels")
def l6(t: Tables) -> DataFrame:
    return learning.folds(t.labels, "doc_id", 5, 7).select("doc_id", "fold")


#: A rooted tree of the points: each hangs below the one before it, every seventh below a seventh of itself.
TREE = "tree AS (SELECT 1 AS tree, node AS id, CASE WHEN node % 7 = 0 THEN CAST(floor(node / 7.0) AS BIGINT) ELSE node - 1 END AS parent, x / 10.0 AS x, y / 10.0 AS y, z / 10.0 AS z FROM N)"


def tree(t: Tables) -> DataFrame:
    parent = F.when(F.col("node") % 7 == 0, F.floor(F.col("node") / 7)).otherwise(F.col("node") - 1)
    return t.N.select(F.lit(1).alias("tree"), F.col("node").alias("id"), parent.alias("parent"), *((F.col(k) / 10.0).alias(k) for k in "xyz"))


BRANCHES = f"""WITH RECURSIVE {TREE}, kids AS (SELECT p.tree, p.id, p.parent, count(c.id) AS children, min(c.id) AS child FROM tree p LEFT JOIN tree c ON c.tree = p.tree AND c.parent = p.id GROUP BY 1, 2, 3),
walk(tree, id, spot, rank) AS (SELECT tree, id, id, 0 FROM tree UNION ALL SELECT w.tree, w.id, k.child, w.rank + 1 FROM walk w JOIN kids k ON k.tree = w.tree AND k.id = w.spot WHERE k.children = 1 AND k.parent > 0),
ends AS (SELECT tree, id, arg_max(spot, rank) AS branch, max(rank) AS rank FROM walk GROUP BY 1, 2), steps AS (SELECT c.tree, c.id, coalesce(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2)), 0) AS step FROM tree c LEFT JOIN tree p ON p.tree = c.tree AND p.id = c.parent),
branch AS (SELECT e.tree, e.branch, count(*) AS n, sum(step) AS length, arg_max(k.parent, e.rank) AS above FROM ends e JOIN steps s USING (tree, id) JOIN kids k USING (tree, id) GROUP BY 1, 2)"""


@query("m1_tree_branches", f"{BRANCHES} SELECT b.tree, b.branch, b.n, round(b.length, 6) AS length, k.children = 0 AS leaf, e.branch AS parent_branch FROM branch b JOIN kids k ON k.tree = b.tree AND k.id = b.branch LEFT JOIN ends e ON e.tree = b.tree AND e.id = b.above")
def m1(t: Tables) -> DataFrame:
    return trees.branch_table(tree(t)).withColumn("length", r6(F.col("length")))


@query("m2_prune_leaf_branches", f"{BRANCHES} SELECT e.tree, e.id FROM ends e JOIN branch b USING (tree, branch) JOIN kids k ON k.tree = b.tree AND k.id = b.branch LEFT JOIN ends p ON p.tree = b.tree AND p.id = b.above WHERE NOT (k.children = 0 AND b.length < 300 AND p.branch IS NOT NULL)")
def m2(t: Tables) -> DataFrame:
    return trees.prune_leaves(tree(t), 300).select("tree", "id")


@query("m3_downsample_tree", f"{BRANCHES}, far AS (SELECT e.tree, e.id, e.branch, coalesce(sum(s.step), 0) AS along FROM ends e LEFT JOIN walk w ON w.tree = e.tree AND w.id = e.id AND w.rank > 0 LEFT JOIN steps s ON s.tree = w.tree AND s.id = w.spot GROUP BY 1, 2, 3), c AS (SELECT tree, id, branch, floor(round(along, 9) / 10.0) AS cell, lag(floor(round(along, 9) / 10.0)) OVER (PARTITION BY tree, branch ORDER BY along, id) AS before FROM far) SELECT tree, id FROM c WHERE id = branch OR cell > before")
def m3(t: Tables) -> DataFrame:
    return trees.downsample(tree(t), 10.0).select("tree", "id")


@query("m4_upsample_tree", f"WITH {TREE}, e AS (SELECT c.tree, c.id, c.x, p.x AS px, sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2) + pow(c.z - p.z, 2)) AS step FROM tree c JOIN tree p ON p.tree = c.tree AND p.id = c.parent), k AS (SELECT *, unnest(range(1, CAST(ceil(step / 4.0) AS BIGINT) + 1)) AS k FROM e WHERE step > 0) SELECT tree, id, round(least(k * 4.0, step), 6) AS at, round(px + (x - px) * least(k * 4.0, step) / step, 6) AS x FROM k")
def m4(t: Tables) -> DataFrame:
    return trees.upsample(tree(t), 4.0).select("tree", "id", r6(F.col("at")).alias("at"), r6(F.col("x")).alias("x"))


def median_sql(source: str) -> str:
    return f"SELECT tree, id, parent, branch, rank, " + ", ".join(f"CASE WHEN id <> branch THEN median({k}) OVER (PARTITION BY tree, branch ORDER BY rank, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE {k} END AS {k}" for k in "xyz") + f" FROM {source}"


@query("m5_smooth_tree", f"{BRANCHES}, placed AS (SELECT t.tree, t.id, t.parent, e.branch, e.rank, x, y, z FROM tree t JOIN ends e USING (tree, id)), once AS ({median_sql('placed')}), twice AS ({median_sql('once')}) SELECT tree, id, parent, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM twice")
def m5(t: Tables) -> DataFrame:
    return trees.smooth(tree(t), width=3).select("tree", "id", "parent", *(r6(F.col(k)).alias(k) for k in "xyz"))
