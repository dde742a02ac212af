"""Query: gap links between free ends of chains, walked through the voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gaps, spatial
from ..sources.scratch import checkpointed
from .chains import D3, chain_sql, linked
from .coordinates import r6
from .registry import Tables, query

#: Lengths of gaps. Both ends are occupied voxels, so none of a gap's voxels is farther than half of it from one.
SHORTEST, LONGEST = 3, 6
#: Voxels narrower than this are their block's background.
FAINT = 2.5
#: Voxels of a chain that tell where it points.
BACK = 10
UNIT = "sqrt(pow(lx - ax, 2) + pow(ly - ay, 2) + pow(lz - az, 2))"


@query("f23_gap_link_features", f"""{chain_sql('V')}, placed AS MATERIALIZED (SELECT label, voxel_id, pos, size, x, y, z, n FROM link JOIN cls USING (voxel_id)),
tips AS MATERIALIZED (SELECT t.*, count(*) OVER (PARTITION BY label) = 2 AS both_free, t.x - q.x AS ox, t.y - q.y AS oy, t.z - q.z AS oz FROM placed t JOIN (SELECT label, pos, x, y, z FROM placed) q USING (label) WHERE t.n = 1 AND q.pos = CASE WHEN t.pos = 1 THEN least({BACK}, t.size) ELSE t.size - least({BACK}, t.size) + 1 END),
pairs AS MATERIALIZED (SELECT a.voxel_id AS a, b.voxel_id AS b, a.size, a.both_free, a.ox, a.oy, a.oz, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, {D3} AS gap, greatest(abs(b.x - a.x), abs(b.y - a.y), abs(b.z - a.z)) AS steps FROM tips a JOIN tips b ON a.label <> b.label AND b.z BETWEEN a.z - {LONGEST} AND a.z + {LONGEST} WHERE {D3} BETWEEN {SHORTEST} AND {LONGEST}),
path AS MATERIALIZED (SELECT a, b, k, CAST(round(ax + (bx - ax) * (k::DOUBLE / steps)) AS BIGINT) AS x, CAST(round(ay + (by_ - ay) * (k::DOUBLE / steps)) AS BIGINT) AS y, CAST(round(az + (bz - az) * (k::DOUBLE / steps)) AS BIGINT) AS z FROM (SELECT *, unnest(range(CAST(steps AS BIGINT) + 1)) AS k FROM pairs) p),
places AS MATERIALIZED (SELECT DISTINCT x, y, z FROM path),
near AS MATERIALIZED (SELECT a.x, a.y, a.z, b.voxel_id, b.r::DOUBLE AS r, {D3} AS distance, row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY {D3}, b.voxel_id) AS i FROM places a JOIN V b ON b.z BETWEEN a.z - 4 AND a.z + 4 AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4),
met AS (SELECT path.*, distance / r AS ratio, CASE WHEN distance = 0 THEN r ELSE 0 END AS value, coalesce(label, 0) AS link FROM path JOIN (SELECT * FROM near WHERE i = 1) q USING (x, y, z) LEFT JOIN link USING (voxel_id)),
one AS (SELECT *, ratio < 1 AS inside, (ratio < 1) <> (lag(ratio) OVER w < 1) AS crosses, ratio > lag(ratio) OVER w AS grows, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM met WINDOW w AS (PARTITION BY a, b ORDER BY k)),
two AS (SELECT *, grows <> lag(grows) OVER (PARTITION BY a, b ORDER BY k) AS turned FROM one),
f AS (SELECT a, b, count(*) AS n, 1 + sum(step) AS length, avg(value) AS mean, stddev_samp(value) AS std, avg(value) FILTER (NOT inside) AS outside_mean, count(DISTINCT link) AS links, count(*) FILTER (NOT inside) / count(*) AS outside, count(*) FILTER (crosses) AS entries, count(*) FILTER (turned) AS turns, avg(ratio) AS ratio_mean, arg_max(x, k) FILTER (NOT inside) AS lx, arg_max(y, k) FILTER (NOT inside) AS ly, arg_max(z, k) FILTER (NOT inside) AS lz FROM two GROUP BY a, b),
faint AS (SELECT block_id, avg(r) AS level, nullif(stddev_samp(r), 0) AS spread FROM V WHERE r < {FAINT} GROUP BY block_id)
SELECT a, b, n, round(length, 6) AS length, round(gap, 6) AS gap, round(gap / length, 6) AS straightness, round((bx - ax) / gap, 6) AS ux, round((by_ - ay) / gap, 6) AS uy, round((bz - az) / gap, 6) AS uz, round(mean, 6) AS mean, round(std, 6) AS std, round((mean - level) / spread, 5) AS snr, round((outside_mean - level) / spread, 5) AS outside_snr, links, round(outside, 6) AS outside_share, entries, turns, round(ratio_mean, 6) AS ratio_mean, size AS chain_voxels, both_free,
CASE WHEN size > 2 THEN round((ox * (lx - ax) + oy * (ly - ay) + oz * (lz - az)) / nullif(sqrt(ox * ox + oy * oy + oz * oz) * {UNIT}, 0), 6) END AS chain_cosine
FROM f JOIN pairs USING (a, b) LEFT JOIN faint ON block_id = CAST(floor((az - 1) / 24.0) AS BIGINT)""")
def f23(t: Tables) -> DataFrame:
    """Gap links from each free end to those of other chains nearby, by the voxels in between.

    Length, chord and direction; values along the way against the faint voxels of the block; the
    nearest voxels' links (those of nodes and rings count as one) and the walk's place in the mask
    that their radii paint; the cosine between where the first chain points and the last voxel
    outside the mask (null without either).
    """
    placed = checkpointed(linked(t.V).where("pos IS NOT NULL"))
    tips = checkpointed(gaps.chain_ends(placed, BACK))
    other = tips.select("voxel_id", "label", "x", "y", "z")
    first = [*(F.col(f"a.{k}").alias(f"a{k}") for k in "xyz"), *(F.col(f"a.{k}").alias(k) for k in ("size", "both_free", "ox", "oy", "oz"))]
    pairs = checkpointed(spatial.within(tips, other, LONGEST).where((F.col("distance") >= SHORTEST) & (F.col("a.label") != F.col("b.label"))).select(F.col("a.voxel_id").alias("a"), F.col("b.voxel_id").alias("b"), *first, *(F.col(f"b.{k}").alias(f"b{k}") for k in "xyz"), F.col("distance").alias("gap")))
    voxels = t.V.join(placed.select("voxel_id", F.col("label").alias("link")), "voxel_id", "left").select("voxel_id", "x", "y", "z", "r", F.coalesce("link", F.lit(0)).alias("link"))
    walk = gaps.walks(pairs).select("a", "b", "k", "x", "y", "z")
    found = gaps.features(gaps.met(walk, voxels, LONGEST / 2 + 1))
    faint = t.V.where(F.col("r") < FAINT).groupBy("block_id").agg(F.avg("r").alias("level"), F.stddev_samp("r").alias("spread"))
    rows = found.join(pairs.hint("merge"), ["a", "b"]).withColumn("block_id", F.floor((F.col("az") - 1) / 24)).join(faint, "block_id", "left")
    c = F.col
    noise = F.when(c("spread") != 0, c("spread"))
    ahead = [(c(f"last.{k}") - c(f"a{k}")).cast("double") for k in "xyz"]
    far = gaps.norm(ahead)
    cosine = sum((c(f"o{k}") * v for k, v in zip("xyz", ahead, strict=True)), F.lit(0.0)) / F.when(far > 0, far)
    return rows.select(
        "a", "b", "n", r6(c("length")).alias("length"), r6(c("gap")).alias("gap"), r6(c("gap") / c("length")).alias("straightness"),
        *(r6((c(f"b{k}") - c(f"a{k}")) / c("gap")).alias(f"u{k}") for k in "xyz"),
        r6(c("mean")).alias("mean"), r6(c("std")).alias("std"), F.round((c("mean") - c("level")) / noise, 5).alias("snr"), F.round((c("outside_mean") - c("level")) / noise, 5).alias("outside_snr"),
        "links", r6(c("outside")).alias("outside_share"), "entries", "turns", r6(c("ratio_mean")).alias("ratio_mean"), c("size").alias("chain_voxels"), "both_free", r6(cosine).alias("chain_cosine"),
    )
