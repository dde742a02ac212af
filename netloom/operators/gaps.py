"""Straight walks between pairs of points, and what they meet on a voxel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .spatial import AXES

PAIR = ["a", "b"]


def norm(columns: list[Column]) -> Column:
    return F.sqrt(sum((c * c for c in columns), F.lit(0.0)))


def walks(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ax.., bx..: whole places) with the voxels from a to b: k from 0, x, y, z.

    A step goes one voxel on along the longest axis, so voxels touch by face, edge or corner, and
    no voxel comes twice. Both ends are on the walk; a pair of one place has one voxel.
    """
    d = {k: F.col(f"b{k}") - F.col(f"a{k}") for k in AXES}
    steps = F.greatest(*(F.abs(v) for v in d.values())).cast("long")
    rows = pairs.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "steps")))
    part = F.when(F.col("steps") > 0, F.col("k") / F.col("steps")).otherwise(0.0)
    return rows.withColumns({k: F.round(F.col(f"a{k}") + d[k] * part).cast("long") for k in AXES})


def met(walk: DataFrame, voxels: DataFrame, reach: float) -> DataFrame:
    """``walk`` with the nearest voxel of ``voxels`` (voxel_id, x, y, z, r, link): distance, r, link, and ratio, the distance over its radius.

    Each place is looked up once, however many walks pass it; ``reach`` is where the search begins.
    Of equally near voxels the least id is taken. Neither the voxels nor the places are broadcast:
    they grow with the input, and much beyond what Spark takes them for.
    """
    places = walk.select(*AXES).distinct()
    near = spatial.nearest(places, voxels, "voxel_id", reach)
    known = near.join(voxels.select("voxel_id", "r", "link").hint("merge"), "voxel_id").select(*AXES, "distance", F.col("r").cast("double").alias("r"), "link")
    return walk.join(known.hint("merge"), list(AXES)).withColumn("ratio", F.col("distance") / F.when(F.col("r") > 0, F.col("r")))


def features(walk: DataFrame) -> DataFrame:
    """One row for each walk of met().

    n and length (steps, and one voxel); mean and std of the value (the radius where a voxel is
    occupied, else 0), and of it outside the mask; links, how many different ones are nearest
    somewhere; outside, the share of voxels that are not within the nearest voxel's radius;
    entries, how often the walk crosses that border; turns, how often the ratio changes from
    growing to not growing or back; ratio_mean; last, the last voxel outside (struct k, x, y, z;
    null if none). Windows see one walk.
    """
    w = Window.partitionBy(*PAIR).orderBy("k")
    before = lambda c: F.lag(c).over(w)
    rows = walk.withColumn("value", F.when(F.col("distance") == 0, F.col("r")).otherwise(0.0)).withColumn("inside", F.col("ratio") < 1)
    rows = rows.withColumn("step", norm([(F.col(k) - before(k)).cast("double") for k in AXES])).withColumn("crosses", F.col("inside") != before("inside")).withColumn("grows", F.col("ratio") > before("ratio"))
    rows = rows.withColumn("turned", F.col("grows") != before("grows"))
    out = F.when(~F.col("inside"), F.col("value"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*PAIR).agg(
        F.count("*").alias("n"),
        (1 + F.coalesce(F.sum("step"), F.lit(0.0))).alias("length"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.avg(out).alias("outside_mean"),
        F.count_distinct("link").alias("links"),
        (n(~F.col("inside")) / F.count("*")).alias("outside"),
        n(F.col("crosses")).alias("entries"),
        n(F.col("turned")).alias("turns"),
        F.avg("ratio").alias("ratio_mean"),
        F.max(F.when(~F.col("inside"), F.struct("k", *AXES))).alias("last"),
    )


def chain_ends(placed: DataFrame, most: int = 10) -> DataFrame:
    """Direction (ox, oy, oz, of length one) in which each chain arrives at its free ends, from the voxel ``most`` - 1 back: voxel_id, label, size, and whether both ends are free.

    placed: voxels of chains with ends (label, pos, size, voxel_id, x, y, z, n). Chains of up to
    two voxels have no direction.
    """
    tips = placed.where("n = 1")
    back = F.least(F.lit(most), F.col("size")) - 1
    rows = tips.withColumn("pos", F.when(F.col("pos") == 1, 1 + back).otherwise(F.col("size") - back))
    tail = placed.select("label", "pos", *(F.col(k).alias(f"t{k}") for k in AXES))
    d = [(F.col(k) - F.col(f"t{k}")).cast("double") for k in AXES]
    whole = F.when(F.col("size") > 2, norm(d))
    free = tips.groupBy("label").agg((F.count("*") == 2).alias("both_free"))
    return rows.join(tail, ["label", "pos"]).join(free, "label").select("voxel_id", "label", "size", "both_free", *(F.col(k) for k in AXES), *((v / whole).alias(f"o{k}") for v, k in zip(d, AXES, strict=True)))
