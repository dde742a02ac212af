"""Queries: fields on voxels (F28, V7, V8, Q18) and tiles that overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, moments, spatial, stats
from ..sources.scratch import checkpointed
from .coordinates import r6
from .registry import Tables, query
from .statistics import bin_sql

D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
TOUCH = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.z BETWEEN a.z - 1 AND a.z + 1"


GRADIENT = "g AS (SELECT c.block_id, c.r, (coalesce(xp.r, 0) - coalesce(xm.r, 0)) / 2.0 AS gx, (coalesce(yp.r, 0) - coalesce(ym.r, 0)) / 2.0 AS gy, (coalesce(zp.r, 0) - coalesce(zm.r, 0)) / 2.0 AS gz FROM V c " + " ".join(f"LEFT JOIN V {k}{s} ON " + " AND ".join(f"{k}{s}.{a} = c.{a}" + (f" {'+' if s == 'p' else '-'} 1" if a == k else "") for a in "xyz") for k in "xyz" for s in "pm") + ")"


@query("f28_field_gradient_axis", f"WITH {GRADIENT}, m AS (SELECT block_id, avg(r) FILTER (r > 0) AS mean, " + ", ".join(f"avg(g{a} * g{b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM g GROUP BY block_id) SELECT block_id, round(mean, 6) AS mean, " + ", ".join(f"round({k}, 6) AS {k}" for k in moments.SIX) + ", round(sqrt(1.5 * greatest(1 - pow(xx + yy + zz, 2) / 3 / nullif(xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz), 0), 0)), 5) AS anisotropy FROM m")
def f28(t: Tables) -> DataFrame:
    """Gradient of the field by differences to the cells before and behind (empty ones are 0), and its uncentred second moment in each block."""
    sides = spatial.shifted(t.V.select("x", "y", "z", "r"), spatial.FACES)
    axis = [F.when(F.col(f"n{k}") != F.col(k), (F.col(k) - F.col(f"n{k}")) * F.col("r") / 2.0).otherwise(0.0).alias(f"g{k}") for k in "xyz"]
    given = sides.select(*(F.col(f"n{k}").alias(k) for k in "xyz"), *axis).groupBy("x", "y", "z").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in "xyz"))
    rows = t.V.join(given, ["x", "y", "z"], "left").select("block_id", "r", *(F.coalesce(f"g{k}", F.lit(0.0)).alias(f"g{k}") for k in "xyz"))
    m = moments.second_moments(rows, ["block_id"], ["gx", "gy", "gz"], centred=False)
    mean = rows.groupBy("block_id").agg(r6(F.avg(F.when(F.col("r") > 0, F.col("r")))).alias("mean"))
    square = F.col("xx") * F.col("xx") + F.col("yy") * F.col("yy") + F.col("zz") * F.col("zz") + 2 * (F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz"))
    trace = F.col("xx") + F.col("yy") + F.col("zz")
    anisotropy = F.when(square > 0, F.sqrt(1.5 * F.greatest(1 - trace * trace / 3 / square, F.lit(0.0)))).otherwise(0.0)
    return m.join(mean, "block_id").select("block_id", "mean", *(r6(F.col(k)).alias(k) for k in moments.SIX), F.round(anisotropy, 5).alias("anisotropy"))


FIELD = "f AS (SELECT voxel_id, x, y, z, r, (voxel_id * 7919) % 1000 / 10.0 AS s FROM V)"


@query("q18_field_extrema", f"""WITH {FIELD}, inner_ AS (SELECT * FROM f WHERE x BETWEEN 2 AND 23 AND y BETWEEN 2 AND 23),
top AS MATERIALIZED (SELECT * FROM inner_ a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE {TOUCH} AND b.r > a.r)), low AS MATERIALIZED (SELECT * FROM inner_ a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE {TOUCH} AND b.s < a.s)),
p AS (SELECT a.voxel_id AS a, b.voxel_id AS b, a.r AS r_a, a.s AS s_a, b.r AS r_b, b.s AS s_b, {D3} AS d FROM top a JOIN low b ON abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND b.z BETWEEN a.z - 6 AND a.z + 6 WHERE {D3} <= 6),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY b ORDER BY d, a) AS j FROM p)
SELECT a, b, round(d, 6) AS distance, r_a, s_a, r_b, s_b FROM k WHERE i = 1 AND j = 1""")
def q18(t: Tables) -> DataFrame:
    """Local maxima of one field and local minima of another, inner cells only, paired where each is the other's nearest within 6; both values of either."""
    f = checkpointed(field(t))

    def extrema(value: str, sign: int) -> DataFrame:
        around = spatial.shifted(f.select("x", "y", "z", (sign * F.col(value)).alias("v")), spatial.ALL).groupBy(*(F.col(f"n{k}").alias(k) for k in "xyz")).agg(F.max("v").alias("most"))
        inner = f.where("x BETWEEN 2 AND 23 AND y BETWEEN 2 AND 23")
        return checkpointed(inner.join(around, ["x", "y", "z"], "left").where(F.col("most").isNull() | (F.col("most") <= sign * F.col(value))).drop("most"))

    top, low = extrema("r", 1), extrema("s", -1)
    pairs = spatial.mutual_nearest(top, low, "voxel_id", 6)
    of = lambda df, k: df.select(F.col("voxel_id").alias(k), F.col("r").alias(f"r_{k}"), F.col("s").alias(f"s_{k}"))
    return pairs.join(of(top, "a"), "a").join(of(low, "b"), "b").select("a", "b", r6(F.col("distance")).alias("distance"), "r_a", "s_a", "r_b", "s_b")


def field(t: Tables) -> DataFrame:
    return t.V.select("voxel_id", "x", "y", "z", "r", ((F.col("voxel_id") * 7919) % 1000 / 10.0).alias("s"))


@query("q18_field_in_bins", f"WITH {FIELD} SELECT {bin_sql('r', [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])} AS bin, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS least, round(max(s), 6) AS most FROM f GROUP BY 1")
def q18_bins(t: Tables) -> DataFrame:
    out = stats.binned_statistics(field(t), "r", "s", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    return out.select("bin", "n", *(r6(F.col(k)).alias(k) for k in ("mean", "std", "least", "most"))).where("n > 0")


LEVELS = (1.5, 2.0, 2.5, 3.0, 3.5, 4.0)


@query("v7_threshold_by_components", f"""WITH RECURSIVE k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(LEVELS))}) v(i, level)), m AS MATERIALIZED (SELECT i, level, voxel_id, x, y, z FROM V JOIN k ON r > level),
adj AS MATERIALIZED (SELECT a.i, a.voxel_id AS u, b.voxel_id AS v FROM m a JOIN m b ON a.i = b.i AND {TOUCH}), reach(i, voxel, root) AS (SELECT i, voxel_id, voxel_id FROM m UNION SELECT adj.i, adj.v, reach.root FROM reach JOIN adj ON adj.i = reach.i AND adj.u = reach.voxel),
cc AS (SELECT i, count(DISTINCT root) AS n FROM (SELECT i, voxel, min(root) AS root FROM reach GROUP BY 1, 2) q GROUP BY i),
faces AS (SELECT i, sum(open)::DOUBLE AS area, count(*)::DOUBLE AS volume FROM (SELECT a.i, a.voxel_id, 6 - count(b.voxel_id) AS open FROM m a LEFT JOIN m b ON a.i = b.i AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY 1, 2) q GROUP BY i),
s AS (SELECT i, level, n::DOUBLE AS n, area, volume, (level + lead(level) OVER w) / 2 AS mid, abs(lead(n) OVER w - n) / n::DOUBLE AS d_n, abs(lead(volume) OVER w - volume) AS d_volume FROM k JOIN cc USING (i) JOIN faces USING (i) WINDOW w AS (ORDER BY i)),
c AS (SELECT unnest([(SELECT median(mid) FROM s WHERE d_n = (SELECT min(d_n) FROM s)), (SELECT median(level) FROM s WHERE area / n = (SELECT max(area / n) FROM s)), (SELECT median(level) FROM s WHERE volume / n = (SELECT max(volume / n) FROM s)), (SELECT median(level) FROM s WHERE pow(area, 3) / pow(volume, 2) = (SELECT min(pow(area, 3) / pow(volume, 2)) FROM s)), (SELECT median(mid) FROM s WHERE d_volume = (SELECT min(d_volume) FROM s))]) AS threshold)
SELECT i, level, n::BIGINT AS n, area::BIGINT AS area, volume::BIGINT AS volume, coalesce((SELECT median(threshold) FROM c WHERE threshold > {LEVELS[0]} + 0.25 AND threshold < {LEVELS[-1]} - 0.25), {(LEVELS[0] + LEVELS[-1]) / 2}) AS chosen FROM s""")
def v7(t: Tables) -> DataFrame:
    """For each candidate level: components, surface and volume of the voxels above; chosen: the median of five criteria's levels that lie inside the range, else its middle.

    One component search serves all levels, on keys of level and voxel.
    """
    levels = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("level")) for i, v in enumerate(LEVELS)))
    m = checkpointed(t.V.select("voxel_id", "x", "y", "z", "r", F.explode(levels).alias("k")).where("r > k.level").select((F.col("voxel_id") * len(LEVELS) + F.col("k.i")).alias("id"), "x", "y", (F.col("z") + F.col("k.i").cast("long") * 10**9).alias("z"), "k.i"))
    found = spatial.touching(m, "id").groupBy((F.col("component") % len(LEVELS)).cast("int").alias("i")).agg(F.count_distinct("component").alias("n"))
    closed = spatial.neighbours(m, "id", spatial.FACES, mirror=False).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("c"))
    faces = m.join(closed, "id", "left").groupBy("i").agg(F.sum(6 - F.coalesce("c", F.lit(0))).alias("area"), F.count("*").alias("volume"))
    every = Window.partitionBy(F.lit(0))  # one row a level
    w = every.orderBy("i")
    s = found.join(faces, "i").withColumn("level", F.element_at(F.array(*map(F.lit, LEVELS)), F.col("i") + 1))
    n, area, volume = F.col("n"), F.col("area").cast("double"), F.col("volume").cast("double")
    mid = (F.col("level") + F.lead("level").over(w)) / 2
    s = s.withColumns({"mid": mid, "c0": F.abs(F.lead("n").over(w) - n) / n, "c1": -area / n, "c2": -volume / n, "c3": area * area * area / (volume * volume), "c4": F.abs(F.lead("volume").over(w) - F.col("volume"))})
    s = checkpointed(s)
    criteria = s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").cast("double").alias("c"), F.col("mid" if k in (0, 4) else "level").alias("at")) for k in range(5)))).alias("q")).select("q.*").where("c IS NOT NULL")
    least = criteria.withColumn("best", F.min("c").over(Window.partitionBy("k"))).where("c = best").groupBy("k").agg(F.median("at").alias("threshold"))
    chosen = least.where((F.col("threshold") > LEVELS[0] + 0.25) & (F.col("threshold") < LEVELS[-1] - 0.25)).agg(F.coalesce(F.median("threshold"), F.lit((LEVELS[0] + LEVELS[-1]) / 2)).alias("chosen"))
    return s.select("i", "level", "n", "area", "volume").crossJoin(F.broadcast(chosen))  # chosen: one row


def _peaks(y: np.ndarray) -> np.ndarray:
    """Places (ends aside) higher than what is before and what comes after; of a level top the first."""
    change = np.flatnonzero(np.diff(y)) + 1  # where a new level begins
    start = np.concatenate([[0], change])
    level = y[start]
    return start[1:-1][(level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])] if len(start) > 2 else start[:0]


def _width(y: np.ndarray, peak: int, by_height: bool) -> float:
    """Width of a peak at half its height or half its prominence, between its own valleys."""
    higher = np.flatnonzero(y > y[peak])
    low = max(higher[higher < peak], default=-1) + 1
    high = min(higher[higher > peak], default=len(y)) - 1
    left, right = low + int(np.argmin(y[low : peak + 1])), peak + int(np.argmin(y[peak : high + 1]))
    at = y[peak] / 2 if by_height else (y[peak] + max(y[left], y[right])) / 2
    i, j = peak, peak
    while i >= left and y[i] > at:
        i -= 1
    while j <= right and y[j] > at:
        j += 1
    begin = left if i < left else i + (at - y[i]) / (y[i + 1] - y[i])
    end = right if j > right else j - (at - y[j]) / (y[j - 1] - y[j])
    return end - begin


def histogram_threshold(counts: np.ndarray, first: int, top: int, apart: int = 8, part: float = 1.0) -> tuple[int, int | None, float | None, int | None]:
    """threshold, background peak, its width and tail, in levels, from the counts of the levels from ``first`` on; ``top`` is the greatest level there can be.

    Peaks are higher than a tenth of an even share, and at least ``apart`` levels from a higher one.
    The highest is the background's if it stands left of all others, else the one nearest to the
    middle of the range, by its half-height width. Behind the tail, a width away, the minimum that is
    nearest in terms of its own width is the threshold; without one it is two widths behind the peak.
    Without a peak it is the least level.
    """
    y = counts / counts.sum()
    found = [int(p) for p in _peaks(y) if y[p] > 0.1 * part / len(y)]
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (-y[p], p)):
        if all(abs(p - q) > apart for q in kept):
            kept.append(p)
    if not kept:
        return first, None, None, None
    widths = [_width(y, p, True) for p in kept]
    at = 0 if kept[0] == min(kept) else min(range(len(kept)), key=lambda i: abs(first + kept[i] - top / 2) / widths[i])
    peak, width = kept[at], widths[at]
    tail = peak + int(np.floor(width + 0.5))
    tail = peak if tail >= len(y) else tail
    behind = -y[tail:]
    dips = _peaks(behind)
    if len(dips):
        best = tail + int(min(dips, key=lambda p: (p + 1) / _width(behind, int(p), False)))
    else:
        best = peak + int(np.floor(2 * width + 0.5))
        best = min(peak + int(np.floor(width + 0.5)), len(y) - 1) if best >= len(y) - 1 else best
    return first + best, first + peak, width, first + tail


def block_thresholds(values: DataFrame, block: str, level: str, top: int) -> DataFrame:
    """block, threshold, peak, width and tail from each block's histogram of whole levels, counted by Spark; levels from 0 to ``top``, so a group has that many rows at most."""
    counted = values.where(F.col(level).between(0, top)).groupBy(F.col(block).alias("block"), F.col(level).cast("int").alias("level")).agg(F.count("*").alias("n"))
    schema = f"block {dict(counted.dtypes)['block']}, threshold int, peak int, width double, tail int"

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["level"].min())
        counts = np.zeros(int(rows["level"].max()) - first + 1)
        counts[rows["level"].to_numpy() - first] = rows["n"].to_numpy()
        return pd.DataFrame([(rows["block"].iloc[0], *histogram_threshold(counts, first, top))], columns=["block", "threshold", "peak", "width", "tail"])

    return counted.groupBy("block").applyInPandas(find, schema)


@query("v8_threshold_by_histogram")
def v8(t: Tables) -> DataFrame:
    """Each block's threshold from the minimum behind its background peak."""
    levels = t.lineitem.select((F.col("l_suppkey") % 8).alias("block"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 500).alias("level"))
    out = block_thresholds(levels, "block", "level", 255)
    return out.select("block", "threshold", "peak", r6(F.col("width")).alias("width"), "tail")


#: Distance from which matched points don't count, share of them that accepts a pair of tiles, rounds of alignment, and gap that keeps tiles apart.
MATCH, RATE, ALIGN, APART = 60.0, 0.5, 2, 1e6


def mutual_sql(k: int) -> str:
    """m{k}: pairs of both sides that are each other's nearest after the shifts s{k} of the tiles."""
    gap = f"sqrt(pow(a.x - (b.x - s{k}.dx), 2) + pow(a.y - (b.y - s{k}.dy), 2) + pow(a.z - (b.z - s{k}.dz), 2))"
    return f"""q{k} AS MATERIALIZED (SELECT a.tile, a.node AS a, b.node AS b, {gap} AS d, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM one a JOIN two b ON a.tile = b.tile JOIN s{k} ON s{k}.tile = a.tile),
m{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i, row_number() OVER (PARTITION BY b ORDER BY d, a) AS j FROM q{k}) q WHERE i = 1 AND j = 1)"""


ALIGNED = "one AS (SELECT node, x, y, z, CAST(floor(x / 250.0) AS BIGINT) AS tile FROM N WHERE side = 0), two AS (SELECT node, x, y, z, CAST(floor(x / 250.0) AS BIGINT) AS tile FROM N WHERE side = 1), s0 AS (SELECT tile, -20.0::DOUBLE AS dx, 10.0::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM one GROUP BY tile), "
ALIGNED += ", ".join(f"{mutual_sql(k)}, s{k + 1} AS (SELECT tile, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM m{k} GROUP BY tile)" for k in range(ALIGN)) + f", {mutual_sql(ALIGN)}"


def mutual(one: DataFrame, two: DataFrame, shift: DataFrame, radius: float) -> DataFrame:
    """tile, a, b, d (distance) and dx, dy, dz (displacement as it is) of points of both sides that are each other's nearest in their tile after its shift is taken off.

    Tiles are set apart along an axis, so one search serves all; every point of a tile with both sides has an answer, however far.
    """
    apart = lambda df, k: df.select(F.col("node").alias(k), "tile", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    a = checkpointed(apart(one, "a").join(two.select("tile").distinct(), "tile", "left_semi"))
    b = checkpointed(apart(two, "b").join(one.select("tile").distinct(), "tile", "left_semi").join(shift, "tile"))
    moved = b.select("b", "tile", *((F.col(c) - F.col(f"d{c}")).alias(c) for c in "xyz"))
    set_apart = lambda df: df.withColumn("z", F.col("z") + F.col("tile") * APART)
    a_at, b_at = set_apart(a), set_apart(moved)

    def best(points: DataFrame, key: str, sources: DataFrame, other: str) -> DataFrame:
        found = spatial.nearest(points.select("x", "y", "z").distinct(), sources, other, radius)
        return points.join(found, ["x", "y", "z"]).select("tile", key, other, "distance")

    pairs = best(a_at, "a", b_at, "b").join(best(b_at, "b", a_at, "a").drop("distance"), ["tile", "a", "b"])
    ends = pairs.join(a.select("a", *(F.col(c).alias(f"a{c}") for c in "xyz")), "a").join(b.select("b", *(F.col(c).alias(f"b{c}") for c in "xyz")), "b")
    return ends.select("tile", "a", "b", F.col("distance").alias("d"), *((F.col(f"b{c}") - F.col(f"a{c}")).alias(f"d{c}") for c in "xyz"))


def aligned(one: DataFrame, two: DataFrame, shift: DataFrame, rounds: int = ALIGN) -> DataFrame:
    """mutual() after the shift has been set to the mean displacement of the mutual pairs, ``rounds`` times; shift: tile, dx, dy, dz as expected."""
    radius = 1.5 * spatial.spacing(one)
    found = checkpointed(mutual(one, two, shift, radius))
    for _ in range(rounds):
        shift = found.groupBy("tile").agg(*(F.avg(f"d{c}").alias(f"d{c}") for c in "xyz"))
        found = checkpointed(mutual(one, two, shift, radius))
    return found


def tile_points(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of both sides with their tile, and the tiles' expected shift."""
    at = t.N.select("node", "side", "x", "y", "z", F.floor(F.col("x") / 250.0).alias("tile"))
    one, two = (at.where(F.col("side") == s).drop("side") for s in (0, 1))
    return one, two, one.select("tile").distinct().select("tile", *(F.lit(v).alias(f"d{c}") for c, v in (("x", -20.0), ("y", 10.0), ("z", 0.0))))


def match_rates(pairs: DataFrame, least: float = MATCH) -> DataFrame:
    """tile, n (mutual pairs) and rate, the share of them that are nearer than ``least``."""
    return pairs.groupBy("tile").agg(F.count("*").alias("n"), F.avg((F.col("d") < least).cast("double")).alias("rate"))


@query("t3_matched_points", f"WITH {ALIGNED}, r AS (SELECT tile, count(*) AS n, avg(CASE WHEN d < {MATCH} THEN 1.0 ELSE 0.0 END) AS rate FROM m{ALIGN} GROUP BY tile) SELECT tile, a, b, round(d, 6) AS distance, n AS mutual_pairs, round(rate, 6) AS rate, rate >= {RATE} AS accepted FROM m{ALIGN} JOIN r USING (tile) WHERE d < {MATCH}")
def t3(t: Tables) -> DataFrame:
    """Points of both sides that are each other's nearest after alignment, and nearer than a threshold; a pair of tiles where these are less than half of the mutual pairs is rejected."""
    found = aligned(*tile_points(t))
    rows = found.where(F.col("d") < MATCH).join(match_rates(found), "tile")
    return rows.select("tile", "a", "b", r6(F.col("d")).alias("distance"), F.col("n").alias("mutual_pairs"), r6(F.col("rate")).alias("rate"), (F.col("rate") >= RATE).alias("accepted"))


#: Neighbours whose displacement is compared, and how far they may be.
MOST, REACH = 20, 300.0
#: Lower edges of the bins of cosines and of deviations (fixed values: 0.1 wide, a last one for its edge alone).
COSINES = [round(-1.05 + 0.1 * i, 2) for i in range(22)]
DEVIATIONS = [round(0.05 + 0.1 * i, 2) for i in range(11)]


def smoothness(v: DataFrame, radius: float = REACH) -> DataFrame:
    """Whether displacements agree with those of their nearest points in the plane: ``v`` (tile, id, x, y, dx, dy) to tile, id, n, cosine_mode, deviation_mode, mean_deviation, outlier.

    k = round(sqrt(points of the tile)), ``MOST`` at most, counts the point itself. Compared are the
    cosine of both displacements and exp(-|difference| / |own|), 1 where they agree, by bins: the
    commonest cosine (of equal ones the least), the commonest deviation (the greatest), and the
    bins' mean. Neighbours at the same place or beyond ``radius`` don't count, nor cosines with a
    displacement of zero; a point without any is an outlier.
    """
    n = v.groupBy("tile").agg(F.least(F.lit(MOST), F.round(F.sqrt(F.count("*"))).cast("int")).alias("k"))
    own = checkpointed(v.join(n, "tile").withColumn("len", F.hypot(F.col("dx"), F.col("dy"))).withColumn("z", F.col("tile") * APART))
    at = ["x", "y", "z"]
    found = spatial.k_nearest(own.groupBy(*at).agg(F.max("k").alias("k")), own, "id", "k", 3 * spatial.spacing(own, ("x", "y")), single=True)
    near = found.withColumnRenamed("id", "other").withColumnRenamed("place", "at_place").join(own, at).where("other <> id")
    rank = F.row_number().over(Window.partitionBy("tile", "id").orderBy("distance", "other"))
    near = near.withColumn("i", rank).where("i < k").where((F.col("distance") > 0) & (F.col("distance") < radius))
    other = own.select("tile", F.col("id").alias("other"), F.col("dx").alias("ox"), F.col("dy").alias("oy"), F.col("len").alias("olen"))
    both = near.join(other, ["tile", "other"])
    cosine = (F.col("dx") * F.col("ox") + F.col("dy") * F.col("oy")) / F.when(F.col("len") * F.col("olen") > 0, F.col("len") * F.col("olen"))
    gap = F.hypot(F.col("dx") - F.col("ox"), F.col("dy") - F.col("oy"))
    deviation = F.when(F.col("len") > 0, F.exp(-gap / F.col("len"))).when(gap > 0, 0.0)
    bin_ = lambda c, first: F.floor((F.round(c, 9) - first) / 0.1 + 1e-9)
    s = checkpointed(both.select("tile", "id", bin_(cosine, COSINES[0]).alias("c"), bin_(deviation, DEVIATIONS[0]).alias("e")))
    counts = lambda b: s.where(F.col(b) >= 0).groupBy("tile", "id", b).agg(F.count("*").alias("m"))
    cosines = counts("c").groupBy("tile", "id").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("c"))
    deviations = counts("e").groupBy("tile", "id").agg(F.max_by("e", F.struct("m", "e")).alias("e"), (F.sum(F.col("m") * F.col("e")) / F.sum("m") / 10).alias("mean"))
    rows = own.select("tile", "id").join(s.groupBy("tile", "id").agg(F.count("*").alias("n")), ["tile", "id"], "left").join(cosines, ["tile", "id"], "left").join(deviations, ["tile", "id"], "left")
    mode, most = F.coalesce(F.round(F.col("c") / 10 - 1, 9), F.lit(-1.0)), F.coalesce(F.round(F.col("e") / 10 + 0.1, 9), F.lit(1.1))
    outlier = (mode < 0.8) | F.coalesce((most < 0.5) & (F.col("mean") < 0.5), F.lit(False))
    return rows.select("tile", "id", F.coalesce("n", F.lit(0)).alias("n"), mode.alias("cosine_mode"), most.alias("deviation_mode"), F.col("mean").alias("mean_deviation"), outlier.alias("outlier"))


@query("t5_displacement_smoothness", f"""WITH {ALIGNED}, v AS (SELECT m.tile, m.a AS id, one.x, one.y, m.dx, m.dy, sqrt(m.dx * m.dx + m.dy * m.dy) AS len FROM m{ALIGN} m JOIN one ON one.node = m.a),
w AS MATERIALIZED (SELECT *, least({MOST}, CAST(round(sqrt(count(*) OVER (PARTITION BY tile))) AS BIGINT)) AS k FROM v),
q AS (SELECT a.tile, a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS far, (a.dx * b.dx + a.dy * b.dy) / nullif(a.len * b.len, 0) AS cosine, CASE WHEN a.len > 0 THEN exp(-sqrt(pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2)) / a.len) WHEN a.dx <> b.dx OR a.dy <> b.dy THEN 0.0 END AS deviation, a.k, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS i FROM w a JOIN w b ON a.id <> b.id AND a.tile = b.tile),
s AS MATERIALIZED (SELECT id, CAST(floor((round(cosine, 9) - {COSINES[0]}::DOUBLE) / 0.1::DOUBLE + 1e-9) AS BIGINT) AS c, CAST(floor((round(deviation, 9) - {DEVIATIONS[0]}::DOUBLE) / 0.1::DOUBLE + 1e-9) AS BIGINT) AS e FROM q WHERE i < k AND far > 0 AND far < {REACH}),
c AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, c) AS o FROM s WHERE c >= 0 GROUP BY id, c), e AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, e DESC) AS o FROM s WHERE e >= 0 GROUP BY id, e), g AS (SELECT id, sum(e) FILTER (e >= 0)::DOUBLE / nullif(count(*) FILTER (e >= 0), 0) / 10 AS mean, count(*) AS n FROM s GROUP BY id),
r AS (SELECT w.tile, w.id, coalesce(n, 0) AS n, coalesce(round(c / 10.0::DOUBLE - 1, 9), -1.0) AS cosine_mode, coalesce(round(e / 10.0::DOUBLE + 0.1, 9), 1.1) AS deviation_mode, mean FROM w LEFT JOIN g USING (id) LEFT JOIN (SELECT * FROM c WHERE o = 1) c USING (id) LEFT JOIN (SELECT * FROM e WHERE o = 1) e USING (id))
SELECT tile, id, n, round(cosine_mode, 6) AS cosine_mode, round(deviation_mode, 6) AS deviation_mode, round(mean, 6) AS mean_deviation, cosine_mode < 0.8 OR coalesce(deviation_mode < 0.5 AND mean < 0.5, false) AS outlier FROM r""")
def t5(t: Tables) -> DataFrame:
    """Displacements of matched points against those of their nearest in the plane."""
    one, two, shift = tile_points(t)
    v = aligned(one, two, shift).join(one.select(F.col("node").alias("a"), "x", "y"), "a").select("tile", F.col("a").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "dx", "dy")
    out = smoothness(v)
    return out.select("tile", "id", "n", *(r6(F.col(k)).alias(k) for k in ("cosine_mode", "deviation_mode", "mean_deviation")), "outlier")


def edges_of_tiles(t: Tables) -> DataFrame:
    """Both directions of the edges between neighbouring tiles: tile, pixel displacement (p0-p2) and stage displacement (s0-s2)."""
    a = t.T.select("tile", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"), "model")
    b = a.select(F.col("tile").alias("other"), *(F.col(k).alias(f"n{k}") for k in "xyz"), F.col("model").alias("model_2"))
    both = spatial.shifted(a, spatial.FACES).join(b, ["nx", "ny", "nz"])
    d = {k: F.col(f"n{k}") - F.col(k) for k in "xyz"}
    noise = (F.col("model_2") - F.col("model")) / 10
    pixel = (200.0 * d["x"] + 3.0 * d["y"], 180.0 * d["y"] - 2.0 * d["x"], 150.0 * d["z"] + 1.0 * d["x"])
    stage = (20.0 * d["x"] + noise, 18.0 * d["y"] - noise, 15.0 * d["z"])
    return both.select("tile", "other", *(p.alias(f"p{i}") for i, p in enumerate(pixel)), *(s.alias(f"s{i}") for i, s in enumerate(stage)))


def affine(edges: DataFrame, key: str) -> DataFrame:
    """a00..a22 of s = A p by least squares for each key, from the sums of the normal equations; keys whose edges don't span space have nulls."""
    three = range(3)
    sums = edges.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"q{i}{j}") for i in three for j in three), *(F.sum(F.col(f"s{i}") * F.col(f"p{j}")).alias(f"t{i}{j}") for i in three for j in three))
    square: list[list[Column]] = [[F.col(f"q{i}{j}") for j in three] for i in three]
    rows = [moments.solve3(square, [F.col(f"t{i}{j}") for j in three]) for i in three]
    return sums.where("n >= 3").select(key, "n", *(rows[i][j].alias(f"a{i}{j}") for i in three for j in three))


NINE = [f"a{i}{j}" for i in range(3) for j in range(3)]


def det_sql(m: list[list[str]]) -> str:
    term = lambda a, b, c, d, e: f"{a} * ({b} * {c} - {d} * {e})"
    return f"({term(m[0][0], m[1][1], m[2][2], m[1][2], m[2][1])} - {term(m[0][1], m[1][0], m[2][2], m[1][2], m[2][0])} + {term(m[0][2], m[1][0], m[2][1], m[1][1], m[2][0])})"


def affine_sql(edges: str) -> str:
    """The least squares of affine() as SQL."""
    three = range(3)
    square = [[f"q{i}{j}" for j in three] for i in three]
    cell = lambda i, k: det_sql([[f"t{i}{row}" if j == k else square[row][j] for j in three] for row in three])
    sums = ", ".join([f"sum(p{i} * p{j}) AS q{i}{j}" for i in three for j in three] + [f"sum(s{i} * p{j}) AS t{i}{j}" for i in three for j in three])
    return f"(SELECT tile, n, {', '.join(f'{cell(i, k)} / nullif({det_sql(square)}, 0) AS a{i}{k}' for i in three for k in three)} FROM (SELECT tile, count(*) AS n, {sums} FROM {edges} GROUP BY tile) sums WHERE n >= 3)"


AFFINE = f"""edges AS MATERIALIZED (SELECT tile, other, 200.0::DOUBLE * dx + 3 * dy AS p0, 180.0::DOUBLE * dy - 2 * dx AS p1, 150.0::DOUBLE * dz + dx AS p2, 20.0::DOUBLE * dx + noise AS s0, 18.0::DOUBLE * dy - noise AS s1, 15.0::DOUBLE * dz AS s2 FROM (SELECT a.tile, b.tile AS other, b.gx - a.gx AS dx, b.gy - a.gy AS dy, b.gz - a.gz AS dz, (b.model - a.model)::DOUBLE / 10 AS noise FROM T a JOIN T b ON abs(a.gx - b.gx) + abs(a.gy - b.gy) + abs(a.gz - b.gz) = 1) d),
one AS MATERIALIZED (SELECT * FROM {affine_sql('edges')} f), good AS MATERIALIZED (SELECT edges.* FROM edges JOIN one USING (tile) WHERE sqrt({' + '.join(f'pow(s{i} - ({" + ".join(f"a{i}{j} * p{j}" for j in range(3))}), 2)' for i in range(3))}) < 1),
aff AS MATERIALIZED (SELECT * FROM {affine_sql('good')} f WHERE a00 IS NOT NULL)"""


def tile_affines(t: Tables) -> DataFrame:
    """Each tile's affine from its edges, fitted again without the edges that are off by one or more."""
    edges = checkpointed(edges_of_tiles(t))
    first = affine(edges, "tile").drop("n")
    off = [F.col(f"s{i}") - sum((F.col(f"a{i}{j}") * F.col(f"p{j}") for j in range(3)), F.lit(0.0)) for i in range(3)]
    good = edges.join(first, "tile").where(F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) < 1)
    return affine(good.select(*edges.columns), "tile").where("a00 IS NOT NULL")


@query("t7_tile_affine", f"WITH {AFFINE} SELECT tile, n, {', '.join(f'round({a}, 6) AS {a}' for a in NINE)} FROM aff")
def t7(t: Tables) -> DataFrame:
    """Each tile's affine."""
    return tile_affines(t).select("tile", "n", *(r6(F.col(a)).alias(a) for a in NINE))


#: Relative norm beyond which a tile's affine doesn't count, and the grid's weights for the nearest reliable tile (layers last).
ODD, GRID = 0.05, (1, 1, 1e5)


def norm_sql(m: list[str]) -> str:
    return f"sqrt({' + '.join(f'pow({v}, 2)' for v in m)})"


def reliable_models(tiles: DataFrame, models: DataFrame, names: list[str], most: float = ODD, weights: tuple[float, ...] = GRID) -> DataFrame:
    """tile, deviation, reliable, source and the source's model for each of ``tiles`` (tile, x, y, z on the grid).

    models: tile and the numbers ``names`` of those that have one. A model is reliable if its
    difference to the mean of all has at most ``most`` times the mean's (Frobenius) norm; every tile
    takes the model of the nearest reliable one, itself if it is (ties: the least tile).
    """
    mean = models.agg(*(F.avg(c).alias(f"m_{c}") for c in names))  # one row
    norm = lambda columns: F.sqrt(sum((v * v for v in columns), F.lit(0.0)))
    off = norm([F.col(c) - F.col(f"m_{c}") for c in names]) / norm([F.col(f"m_{c}") for c in names])
    judged = models.crossJoin(F.broadcast(mean)).select("tile", off.alias("deviation"), *names)
    good = checkpointed(judged.where(F.col("deviation") <= most).join(tiles, "tile"))
    at = ["x", "y", "z"]
    near = spatial.nearest(tiles.select(*at).distinct(), good.select(*at, F.col("tile").alias("source")), "source", 2, weights).select(*at, "source")
    taken = tiles.join(near, at).join(good.select(F.col("tile").alias("source"), *names), "source")
    return taken.join(judged.select("tile", "deviation"), "tile", "left").select("tile", "deviation", F.coalesce(F.col("deviation") <= most, F.lit(False)).alias("reliable"), "source", *names)


@query("t8_unreliable_tiles", f"WITH {AFFINE}, mean AS (SELECT {', '.join(f'avg({a}) AS m_{a}' for a in NINE)} FROM aff), judged AS MATERIALIZED (SELECT aff.*, {norm_sql([f'({a} - m_{a})' for a in NINE])} / {norm_sql([f'm_{a}' for a in NINE])} AS deviation FROM aff, mean), sound AS (SELECT judged.*, gx, gy, gz FROM judged JOIN T USING (tile) WHERE deviation <= {ODD}), near AS (SELECT a.tile, b.tile AS source, {', '.join(f'b.{a}' for a in NINE)}, row_number() OVER (PARTITION BY a.tile ORDER BY sqrt(pow(a.gx - b.gx, 2) + pow(a.gy - b.gy, 2) + pow((a.gz - b.gz) * {GRID[2]}, 2)), b.tile) AS i FROM T a, sound b) SELECT tile, round(deviation, 6) AS deviation, coalesce(deviation <= {ODD}, false) AS reliable, source, {', '.join(f'round(near.{a}, 6) AS {a}' for a in NINE)} FROM near LEFT JOIN (SELECT tile, deviation FROM judged) j USING (tile) WHERE i = 1")
def t8(t: Tables) -> DataFrame:
    """Tiles whose affine is missing or far from the mean one take the nearest reliable tile's."""
    tiles = t.T.select("tile", *(F.col(f"g{k}").alias(k) for k in "xyz"))
    out = reliable_models(tiles, tile_affines(t).drop("n"), NINE)
    return out.select("tile", r6(F.col("deviation")).alias("deviation"), "reliable", "source", *(r6(F.col(a)).alias(a) for a in NINE))


@query("t12_match_quality", "WITH m AS (SELECT a.gz, 200.0 * a.gx + a.model AS x1, 180.0 * a.gy - a.model AS y1, 150.0 * a.gz AS z1, 200.0 * (b.gx - 1) + b.model AS x2, 180.0 * b.gy - b.model AS y2, 150.0 * b.gz + b.model AS z2 FROM T a JOIN T b ON b.gx = a.gx + 1 AND b.gy = a.gy AND b.gz = a.gz) SELECT gz AS layer, count(*) AS pairs, round(avg(x2 - x1), 6) AS u, round(avg(y2 - y1), 6) AS v, round(avg(z2 - z1), 6) AS w, round(max(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2))), 6) AS most FROM m GROUP BY gz")
def t12(t: Tables) -> DataFrame:
    """Per layer: displacement of the shared points of neighbouring tiles after each tile's transform, and the largest distance."""
    g, m = F.col, F.col("model")
    one = t.T.select("gx", "gy", "gz", (200.0 * g("gx") + m).alias("x1"), (180.0 * g("gy") - m).alias("y1"), (150.0 * g("gz")).alias("z1"))
    two = t.T.select((g("gx") - 1).alias("gx"), "gy", "gz", (200.0 * (g("gx") - 1) + m).alias("x2"), (180.0 * g("gy") - m).alias("y2"), (150.0 * g("gz") + m).alias("z2"))
    d = [g(f"{k}2") - g(f"{k}1") for k in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return one.join(two, ["gx", "gy", "gz"]).groupBy(g("gz").alias("layer")).agg(F.count("*").alias("pairs"), *(r6(F.avg(v)).alias(n) for v, n in zip(d, "uvw", strict=True)), r6(F.max(far)).alias("most"))
