"""Deletion of selected links one after another, as if in order, in rounds of links that don't touch each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed
from . import graph

LINK = ("link_label", "node_a", "node_b", "size")


def _ends(links: DataFrame) -> DataFrame:
    """A row for each end of a link at a node; 0 and null are free ends."""
    return links.select("link_label", F.explode(F.array("node_a", "node_b")).alias("node")).where("node > 0")


def _merged(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with the two links at each of ``nodes`` made one (least label, sizes and nodes summed), and the labels that took part."""
    ends = checkpointed(_ends(links).join(nodes, "node"))
    joins = ends.groupBy("node").agg(F.min("link_label").alias("u"), F.max("link_label").alias("v"))
    part = checkpointed(graph.components(joins.select("u", "v")).select(F.col("node").alias("link_label"), F.col("component").alias("chain")))
    taken = links.join(part, "link_label")
    free = taken.select("chain", F.explode(F.array("node_a", "node_b")).alias("node")).join(nodes, "node", "left_anti")
    tips = free.groupBy("chain").agg(F.sort_array(F.collect_list("node"), asc=False).alias("tips"))  # two of each chain, none of a ring
    extra = joins.join(part, joins["u"] == part["link_label"]).groupBy("chain").agg(F.count("*").alias("inner"))
    sizes = taken.groupBy("chain").agg(F.sum("size").alias("size")).join(extra, "chain").join(tips, "chain", "left")
    tip = lambda i: F.coalesce(F.get("tips", F.lit(i)), F.lit(0)).cast("long")
    new = sizes.select(F.col("chain").alias("link_label"), tip(0).alias("node_a"), tip(1).alias("node_b"), (F.col("size") + F.col("inner")).alias("size"))
    return links.join(part, "link_label", "left_anti").unionByName(new), part.select("link_label")


def guarded_delete(links: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that are left, and the report: link_label and status of each selected link.

    links: link_label, node_a, node_b (0: free end), size. selected: link_label and ``ord`` (all
    different), the order in which links are looked at. A link is ``deleted`` if all its nodes have
    three ends or more; else it would leave an ``endpoint`` and stays; without nodes it stays, too.
    A node that is left with two ends joins them to one link, whose size is theirs and the node's
    (1), and a node with one end becomes free. A selected link that was part of such a join before
    its turn has ``changed`` and stays. A label that isn't among the links is ``gone``.

    Each round takes the links that come first at all their nodes. What happens to a link depends
    only on its own nodes, so the outcome is that of one deletion after another. The first link in
    order is always taken: the rounds end.
    """
    left = checkpointed(links.select("link_label", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("node_a", "node_b")), F.col("size").cast("long").alias("size")))
    known = selected.join(left.select("link_label"), "link_label", "left_semi")
    report = selected.join(left.select("link_label"), "link_label", "left_anti").select("link_label", F.lit("gone").alias("status"))
    waiting = checkpointed(known.select("link_label", "ord"))
    while not waiting.isEmpty():
        ends = checkpointed(_ends(left).join(waiting, "link_label", "left"))
        nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min("ord").alias("first"))
        own = ends.where("ord IS NOT NULL").join(nodes, "node").groupBy("link_label").agg(F.min("first").alias("first"), F.min("degree").alias("degree"))
        turn = waiting.join(own, "link_label", "left").where("first IS NULL OR first = ord")
        status = F.when(F.col("degree").isNull(), "without nodes").when(F.col("degree") > 2, "deleted").otherwise("endpoint")
        turn = checkpointed(turn.select("link_label", status.alias("status")))
        report = report.unionByName(turn)
        waiting = waiting.join(turn, "link_label", "left_anti")
        gone = turn.where("status = 'deleted'").select("link_label")
        if not gone.isEmpty():
            touched = ends.join(gone, "link_label", "left_semi").select("node").distinct()
            left = checkpointed(left.join(gone, "link_label", "left_anti"))
            after = checkpointed(_ends(left).join(touched, "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree")))
            bare = after.where("degree = 1").select(F.col("node").alias("bare"))
            for k in ("node_a", "node_b"):
                left = left.join(bare, left[k] == bare["bare"], "left").withColumn(k, F.when(F.col("bare").isNull(), F.col(k)).otherwise(0)).drop("bare")
            left, joined = _merged(checkpointed(left), after.where("degree = 2").select("node"))
            left, joined = checkpointed(left), checkpointed(joined)
            report = report.unionByName(waiting.join(joined, "link_label", "left_semi").select("link_label", F.lit("changed").alias("status")))
            waiting = waiting.join(joined, "link_label", "left_anti")
        waiting, report = checkpointed(waiting), checkpointed(report)
    return left, report
