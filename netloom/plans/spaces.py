"""Queries: space around links (F15, F17, F20, F22, F27), tiles (T14, T16), volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import moments, spatial
from ..sources.scratch import checkpointed
from .chains import chain_sql, linked
from .coordinates import r6
from .registry import Tables, query

D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


def all_nearest_sql(cells: str, sources: str) -> str:
    """near (x, y, z, label, d, i): the nearest source of each cell, however far."""
    return f"near AS (SELECT x, y, z, m.v AS label, m.d AS d, 1 AS i FROM (SELECT a.x, a.y, a.z, min(struct_pack(d := {D3}, v := b.voxel_id)) AS m FROM (SELECT * FROM V WHERE {cells}) a, (SELECT * FROM V WHERE {sources}) b GROUP BY 1, 2, 3) p)"


FACE = "x IN (1, 24) OR y IN (1, 24)"


@query("f15_tissue_regions", f"WITH {all_nearest_sql('r < 1', 'r >= 4')} SELECT label, CASE WHEN NOT bool_or({FACE}) THEN count(*) END AS volume, CASE WHEN NOT bool_or({FACE}) THEN round(avg(d), 6) END AS mean, CASE WHEN NOT bool_or({FACE}) THEN round(max(d), 6) END AS most, CASE WHEN NOT bool_or({FACE}) THEN round(median(d), 6) END AS median FROM near WHERE i = 1 GROUP BY label")
def f15(t: Tables) -> DataFrame:
    """Cells by nearest source: volume and distances; null where the region touches a face."""
    near = spatial.nearest_source(t.V.where("r < 1"), t.V.where("r >= 4"), "voxel_id")
    inner = ~F.bool_or(F.expr(FACE))
    return near.groupBy(F.col("voxel_id").alias("label")).agg(F.when(inner, F.count("*")).alias("volume"), F.when(inner, r6(F.avg("distance"))).alias("mean"), F.when(inner, r6(F.max("distance"))).alias("most"), F.when(inner, r6(F.median("distance"))).alias("median"))


@query("f17_small_to_large", f"WITH {all_nearest_sql('r < 2', 'r >= 4.5')}, served AS (SELECT CAST(floor((z - 1) / 24.0) AS BIGINT) AS block_id, label, d FROM near WHERE i = 1), votes AS (SELECT block_id, label, row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, label) AS i FROM served GROUP BY 1, 2) SELECT s.block_id, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, any_value(v.label) AS modal FROM served s JOIN votes v ON v.block_id = s.block_id AND v.i = 1 GROUP BY 1")
def f17(t: Tables) -> DataFrame:
    """Small voxels of each block: distance to the nearest large one, and the large one that serves most (ties: the least)."""
    near = spatial.nearest_source(t.V.where("r < 2"), t.V.where("r >= 4.5"), "voxel_id")
    served = near.select(F.floor((F.col("z") - 1) / 24).alias("block_id"), F.col("voxel_id").alias("label"), "distance")
    votes = served.groupBy("block_id", "label").agg(F.count("*").alias("n")).groupBy("block_id").agg(F.min(F.struct(-F.col("n"), F.col("label"))).alias("m")).select("block_id", F.col("m.label").alias("modal"))
    sums = served.groupBy("block_id").agg(F.count("*").alias("n"), r6(F.avg("distance")).alias("mean"), r6(F.median("distance")).alias("median"))
    return sums.join(votes, "block_id")


def r8(c: Column) -> Column:
    return F.round(c, 8)


COARSE = "SELECT DISTINCT (x - 1) // 4 AS x, (y - 1) // 4 AS y, (z - 1) // 4 AS z FROM V"


@query("f20_distance_to_surface", f"WITH c AS ({COARSE}), d AS (SELECT a.x, a.y, a.z, min({D3}) AS d FROM c a, c b WHERE b.x IN (0, 5) OR b.y IN (0, 5) GROUP BY 1, 2, 3) SELECT block_id, round(avg(4 * d), 6) AS distance FROM V JOIN d ON d.x = (V.x - 1) // 4 AND d.y = (V.y - 1) // 4 AND d.z = (V.z - 1) // 4 GROUP BY block_id")
def f20(t: Tables) -> DataFrame:
    """Mean over each block's voxels of the distance to the surface, a field on cells of four voxels: the nearest cell at an outer side."""
    cell = t.V.select("block_id", *(F.expr(f"({k} - 1) div 4").alias(k) for k in "xyz"))
    coarse = cell.select("x", "y", "z").distinct()
    surface = coarse.where("x IN (0, 5) OR y IN (0, 5)").withColumn("label", F.lit(1))
    field = spatial.nearest_source(coarse, surface, "label", 2)
    return cell.join(field, ["x", "y", "z"]).groupBy("block_id").agg(r6(F.avg(4 * F.col("distance"))).alias("distance"))


@query("f22_classifier_link_features", f"""{chain_sql('V')}, o AS MATERIALIZED (SELECT label, pos, size, V.x, V.y, V.z, V.r FROM link JOIN V USING (voxel_id) WHERE size >= 3),
st AS (SELECT a.label, sum({D3}) AS steps FROM o a JOIN o b ON a.label = b.label AND b.pos = a.pos + 1 GROUP BY 1),
s AS (SELECT label, any_value(size) AS n, avg(r) AS mean, stddev_samp(r) AS std, median(r) AS median, min(r) AS least, max(r) AS most, max(r) FILTER (pos = 1) AS first, max(r) FILTER (pos = size) AS last, max(r) FILTER (pos = (size + 1) // 2) AS middle, arg_min(pos, r * 1000000 + pos) AS place,
 max(x) FILTER (pos = 1) AS ax, max(y) FILTER (pos = 1) AS ay, max(z) FILTER (pos = 1) AS az, max(x) FILTER (pos = size) AS bx, max(y) FILTER (pos = size) AS by_, max(z) FILTER (pos = size) AS bz,
 min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1, min(z) - 2 AS z0, max(z) + 2 AS z1 FROM o GROUP BY label),
g AS (SELECT s.label, count(*) AS bg_n, avg(V.r) AS bg_mean, stddev_samp(V.r) AS bg_std FROM s JOIN V ON V.z BETWEEN z0 AND z1 AND V.x BETWEEN x0 AND x1 AND V.y BETWEEN y0 AND y1 WHERE (s.label, V.x, V.y, V.z) NOT IN (SELECT (label, x, y, z) FROM o) GROUP BY 1),
w AS (SELECT s.*, 1 + steps AS length, sqrt(pow(ax - bx, 2) + pow(ay - by_, 2) + pow(az - bz, 2)) AS chord, coalesce(bg_n, 0) AS bg_n, bg_mean, bg_std FROM s JOIN st USING (label) LEFT JOIN g USING (label))
SELECT label, n, round(mean, 8) AS mean, round(std, 8) AS std, round(median, 8) AS median, least, most, first, last, middle, round(place / n, 8) AS least_at, round(mean / nullif(std, 0), 8) AS snr,
 round(abs(first - last), 8) AS end_difference, round((most - least) / length, 8) AS range_over_length, round((first + last) / nullif(chord, 0), 8) AS ends_over_chord, round(chord / length, 8) AS straightness, bg_n, round(bg_mean, 8) AS bg_mean, round(bg_std, 8) AS bg_std,
 round(mean / nullif(bg_mean, 0), 8) AS over_background, round((mean - bg_mean) / nullif(bg_std, 0), 8) AS contrast, round(least / nullif(bg_mean, 0), 8) AS least_over_background, round((first + last) / 2 / nullif(middle, 0), 8) AS ends_over_middle FROM w""")
def f22(t: Tables) -> DataFrame:
    """Of links of three voxels or more: values along the voxels, radii against length and chord, and the voxels around in the bounding box grown by 2."""
    v = checkpointed(t.V.select("voxel_id", "x", "y", "z", "r"))
    o = checkpointed(linked(v).where("pos IS NOT NULL AND size >= 3").select("label", "voxel_id", "pos", "size").join(v, "voxel_id"))
    at = lambda c, k="r": F.max(F.when(c, F.col(k)))
    first, last = F.col("pos") == 1, F.col("pos") == F.col("size")
    step = o.select("label", (F.col("pos") - 1).alias("pos"), *(F.col(k).alias(f"n{k}") for k in "xyz"))
    gap = lambda a, b: F.sqrt(sum((F.pow((F.col(p) - F.col(q)).cast("double"), F.lit(2.0)) for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    steps = o.join(step, ["label", "pos"]).groupBy("label").agg(F.sum(gap(("x", "y", "z"), ("nx", "ny", "nz"))).alias("steps"))
    s = o.groupBy("label").agg(
        F.max("size").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.median("r").alias("median"), F.min("r").alias("least"), F.max("r").alias("most"),
        at(first).alias("first"), at(last).alias("last"), at(F.col("pos") == F.expr("(size + 1) div 2")).alias("middle"), F.min(F.struct("r", "pos"))["pos"].alias("at"),
        *(at(c, k).alias(f"{p}{k}") for p, c in (("a", first), ("b", last)) for k in "xyz"), *((f(k) + d).alias(f"{k}{i}") for k in "xyz" for i, f, d in ((0, F.min, -2), (1, F.max, 2))),
    )
    # the box in cells of eight voxels, which voxels are met in by equality
    cut = lambda k, i: F.floor(F.col(f"{k}{i}") / 8)
    boxes = s.select("label", *(f"{k}{i}" for k in "xyz" for i in (0, 1)))
    for i, k in enumerate("xyz"):
        boxes = boxes.withColumn(f"c{i}", F.explode(F.sequence(cut(k, 0), cut(k, 1))))
    inside = boxes.join(spatial.cells(v, 8), ["c0", "c1", "c2"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
    around = inside.join(o.select("label", "voxel_id"), ["label", "voxel_id"], "left_anti").groupBy("label").agg(F.count("*").alias("bg_n"), F.avg("r").alias("bg_mean"), F.stddev_samp("r").alias("bg_std"))
    w = s.join(steps, "label").join(around, "label", "left").withColumn("length", 1 + F.col("steps")).withColumn("chord", gap(("ax", "ay", "az"), ("bx", "by", "bz")))
    c, over = F.col, lambda a, b: r8(a / F.when(b != 0, b))
    return w.select(
        "label", "n", *(r8(c(k)).alias(k) for k in ("mean", "std", "median")), "least", "most", "first", "last", "middle", r8(c("at") / c("n")).alias("least_at"), over(c("mean"), c("std")).alias("snr"),
        r8(F.abs(c("first") - c("last"))).alias("end_difference"), r8((c("most") - c("least")) / c("length")).alias("range_over_length"), over(c("first") + c("last"), c("chord")).alias("ends_over_chord"), r8(c("chord") / c("length")).alias("straightness"),
        F.coalesce("bg_n", F.lit(0)).alias("bg_n"), r8(c("bg_mean")).alias("bg_mean"), r8(c("bg_std")).alias("bg_std"), over(c("mean"), c("bg_mean")).alias("over_background"), over(c("mean") - c("bg_mean"), c("bg_std")).alias("contrast"),
        over(c("least"), c("bg_mean")).alias("least_over_background"), over((c("first") + c("last")) / 2, c("middle")).alias("ends_over_middle"),
    )


RANGES = [(0, 2), (1, 3), (2, 4), (0, 5)]
UNIT = "SELECT block_id, r, length::DOUBLE AS w, (CASE WHEN vz < 0 THEN -1 ELSE 1 END) * vx / g AS x, (CASE WHEN vz < 0 THEN -1 ELSE 1 END) * vy / g AS y, (CASE WHEN vz < 0 THEN -1 ELSE 1 END) * vz / g AS z FROM (SELECT *, sqrt(pow(vx, 2) + pow(vy, 2) + pow(vz, 2)) AS g FROM C) c WHERE g > 0"


@query("f27_anisotropy_by_radius", f"WITH u AS ({UNIT}), k AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b in RANGES)}) v(low, high)), m AS (SELECT block_id, low, high, count(*) AS n, sum(w) AS weight, " + ", ".join(f"sum(w * {a} * {b}) / (sum(w) - 1) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM u JOIN k ON r >= low AND r < high GROUP BY 1, 2, 3) SELECT block_id, low, high, n, round(weight, 5) AS weight, round(sqrt(1.5 * greatest(1 - pow(xx + yy + zz, 2) / 3 / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 0)), 5) AS fractional_anisotropy FROM m WHERE n >= 3")
def f27(t: Tables) -> DataFrame:
    """Length-weighted anisotropy of directions in overlapping radius ranges; the few ranges are literals."""
    g = F.sqrt(sum((F.col(f"v{k}") * F.col(f"v{k}") for k in "xyz"), F.lit(0.0)))
    flip = F.when(F.col("vz") < 0, -1).otherwise(1)
    ranges = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in RANGES))
    unit = t.C.withColumn("g", g).where("g > 0").select("block_id", "r", "length", *((flip * F.col(f"v{k}") / F.col("g")).alias(k) for k in "xyz"), F.explode(ranges).alias("k")).where("r >= k.low AND r < k.high").select("*", "k.low", "k.high")
    keys = ["block_id", "low", "high"]
    m = moments.second_moments(unit, keys, ["x", "y", "z"], sample=True, weight="length", centred=False).where("n >= 3")
    weights = unit.groupBy(*keys).agg(F.round(F.sum("length"), 5).alias("weight"))
    fa = moments.anisotropy(moments.eigenvalues([F.col(k) for k in moments.SIX]))
    return m.join(weights, keys).select(*keys, "n", "weight", F.round(fa, 5).alias("fractional_anisotropy"))


@query("t14_tiles_to_rematch", "WITH s AS (SELECT tile, gx, gy, gz, model, abs(model) AS matches, max(abs(model)) OVER (PARTITION BY gz) AS best FROM T), k AS (SELECT *, matches >= least(5, greatest(2.5, best)) AS good FROM s), p AS (SELECT a.tile, b.model, row_number() OVER (PARTITION BY a.tile ORDER BY pow(a.gx - b.gx, 2) + 2.5 * pow(a.gy - b.gy, 2) + 1000000.0 * pow(a.gz - b.gz, 2), b.tile) AS i FROM k a JOIN k b ON a.gz = b.gz AND b.good AND NOT a.good), m AS (SELECT tile, round(avg(model), 3) AS shift FROM p WHERE i <= 2 GROUP BY tile) SELECT k.tile, good, CASE WHEN good THEN NULL ELSE shift END AS shift FROM k LEFT JOIN m USING (tile)")
def t14(t: Tables) -> DataFrame:
    """Tiles with too few matches take the mean shift of the two nearest reliable tiles of their layer; none: null."""
    layer = Window.partitionBy("gz")
    s = t.T.select("tile", "gx", "gy", "gz", "model", F.abs("model").alias("matches")).withColumn("best", F.max("matches").over(layer))
    k = s.withColumn("good", F.col("matches") >= F.least(F.lit(5.0), F.greatest(F.lit(2.5), F.col("best"))))
    a, b = k.where("NOT good").alias("a"), k.where("good").alias("b")
    far = F.pow(F.col("a.gx") - F.col("b.gx"), F.lit(2)) + 2.5 * F.pow(F.col("a.gy") - F.col("b.gy"), F.lit(2))
    p = a.join(b, F.col("a.gz") == F.col("b.gz")).select(F.col("a.tile").alias("tile"), F.col("b.model").alias("model"), F.row_number().over(Window.partitionBy("a.tile").orderBy(far, "b.tile")).alias("i"))
    m = p.where("i <= 2").groupBy("tile").agg(F.round(F.avg("model"), 3).alias("shift"))
    return k.join(m, "tile", "left").select("tile", "good", "shift")


@query("t16_per_tile_scale", "SELECT a.tile, b.tile AS other, round(abs(200.0 / (200 + b.model - a.model)), 6) AS scale FROM T a JOIN T b ON b.gx = a.gx + 1 AND b.gy = a.gy AND b.gz = a.gz")
def t16(t: Tables) -> DataFrame:
    """Stage over modelled displacement to the next tile on the first axis."""
    ahead = t.T.select((F.col("gx") - 1).alias("gx"), "gy", "gz", F.col("tile").alias("other"), F.col("model").alias("model_2"))
    return t.T.join(ahead, ["gx", "gy", "gz"]).select("tile", "other", r6(F.abs(200.0 / (200 + F.col("model_2") - F.col("model")))).alias("scale"))


@query("v2_pyramid", "WITH RECURSIVE p(level, x, y, z, n, most) AS (SELECT * FROM (SELECT 0 AS level, x - 1, y - 1, z - 1, 1::BIGINT, r FROM V) f)" + "".join(f", l{k} AS (SELECT {k} AS level, x // 2 AS x, y // 2 AS y, z // 2 AS z, sum(n)::BIGINT AS n, max(most) AS most FROM {'p' if k == 1 else f'l{k - 1}'} GROUP BY 2, 3, 4)" for k in (1, 2, 3)) + " SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3")
def v2(t: Tables) -> DataFrame:
    """Three coarser levels, each built from the one below: occupied voxels and the greatest value."""
    level = t.V.select(*((F.col(k) - 1).alias(k) for k in "xyz"), F.lit(1).cast("long").alias("n"), F.col("r").alias("most"))
    out = None
    for k in (1, 2, 3):
        level = level.groupBy(*(F.expr(f"{a} div 2").alias(a) for a in "xyz")).agg(F.sum("n").alias("n"), F.max("most").alias("most"))
        rows = level.withColumn("level", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out
