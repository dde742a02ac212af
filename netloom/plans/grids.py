"""Queries: grids of overlapping blocks in three axes (Q2, Q3, Q5), their merge (V12) and painted balls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids
from .coordinates import r6
from .graphs import dense_labels
from .registry import Tables, query

#: Blocks of the grid, and blocks of blocks.
SIZE, OVERLAP, JOINED, SHARED = 10, 2, 3, 1
EXTENTS = (24, 24, "zmax")
STEP = SIZE - OVERLAP
LEAST = 0.02


def along_sql(n: str, size: int, overlap: int) -> str:
    return f"greatest(CAST(ceil(({n} - {overlap}) / {size - overlap}.0) AS BIGINT), 1)"


def held_sql(at: str, n: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"unnest(range(greatest(CAST(ceil(({at} - {size}) / {step}.0) AS BIGINT) + 1, 1), least(CAST(floor(({at} - 1) / {step}.0) AS BIGINT) + 1, {along_sql(n, size, overlap)}) + 1))"


def low_sql(i: int) -> str:
    return f"(g{i} - 1) * {STEP} + 1"


HELD = f"ext AS (SELECT max(z) AS zmax FROM V), i0 AS (SELECT V.*, zmax, {held_sql('x', '24', SIZE, OVERLAP)} AS g0 FROM V, ext), i1 AS (SELECT *, {held_sql('y', '24', SIZE, OVERLAP)} AS g1 FROM i0), held AS MATERIALIZED (SELECT *, {held_sql('z', 'zmax', SIZE, OVERLAP)} AS g2 FROM i1)"
COUNTS = [along_sql(n, SIZE, OVERLAP) for n in ("24", "24", "zmax")]
BLOCKS = f"""{HELD}, counted AS (SELECT g0, g1, g2, zmax, count(*) AS n FROM held WHERE r > 1 GROUP BY 1, 2, 3, 4),
blocks AS MATERIALIZED (SELECT *, g0 + {COUNTS[0]} * (g1 - 1) + {COUNTS[0]} * {COUNTS[1]} * (g2 - 1) AS ind, n::DOUBLE / ((high0 - low0 + 1) * (high1 - low1 + 1) * (high2 - low2 + 1)) AS share FROM (SELECT *, {', '.join(f'{low_sql(i)} AS low{i}, least({low_sql(i)} + {SIZE - 1}, {n}) AS high{i}' for i, n in enumerate(('24', '24', 'zmax')))} FROM counted) c),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ind) AS label FROM blocks WHERE share > {LEAST})"""


def with_extent(t: Tables) -> DataFrame:
    """The voxels with the volume's extent on the third axis."""
    return t.V.crossJoin(F.broadcast(t.V.agg(F.max("z").alias("zmax"))))  # one row


def block_shares(t: Tables) -> DataFrame:
    """Blocks that hold mask voxels: place on the grid, index, bounds, n and the share of the block's own volume."""
    held = grids.in_blocks(with_extent(t).where("r > 1"), EXTENTS, SIZE, OVERLAP)
    counts = held.groupBy(*grids.BLOCK, "zmax").agg(F.count("*").alias("n"))
    ends = {f"{name}{i}": v for i, n in enumerate(EXTENTS) for name, v in zip(("low", "high"), grids.bounds(f"g{i}", n, SIZE, OVERLAP), strict=True)}
    volume = F.lit(1)
    for i in range(3):
        volume = volume * (F.col(f"high{i}") - F.col(f"low{i}") + 1)
    return counts.withColumns(ends).select("*", grids.block_index(EXTENTS, SIZE, OVERLAP).alias("ind"), (F.col("n") / volume).alias("share"))


def kept_blocks(t: Tables) -> DataFrame:
    return dense_labels(block_shares(t).where(F.col("share") > LEAST), "ind")


@query("q2_blocks_covering_mask", f"WITH {BLOCKS} SELECT label, ind, g0, g1, g2, {', '.join(f'low{i}, high{i}' for i in range(3))}, n, round(share, 9) AS share FROM kept")
def q2(t: Tables) -> DataFrame:
    """Blocks of an overlapping grid whose share of mask voxels, of the block's own clipped volume, exceeds a limit; labels follow the grid."""
    return kept_blocks(t).select("label", "ind", *grids.BLOCK, *(f"{e}{i}" for i in range(3) for e in ("low", "high")), "n", F.round("share", 9).alias("share"))


def joined_sql(i: int) -> str:
    n = ("24", "24", "zmax")[i]
    first = f"((h{i} - 1) * {JOINED - SHARED} + 1)"
    last = f"least({first} + {JOINED - 1}, {COUNTS[i]})"
    return f"{first} AS first{i}, {last} AS last{i}, ({first} - 1) * {STEP} + 1 AS low{i}, least(({last} - 1) * {STEP} + {SIZE}, {n}) AS high{i}"


@query("q3_combined_grid", f"WITH {BLOCKS}, j0 AS (SELECT *, {held_sql('g0', COUNTS[0], JOINED, SHARED)} AS h0 FROM kept), j1 AS (SELECT *, {held_sql('g1', COUNTS[1], JOINED, SHARED)} AS h1 FROM j0), j2 AS (SELECT *, {held_sql('g2', COUNTS[2], JOINED, SHARED)} AS h2 FROM j1), grp AS (SELECT h0, h1, h2, zmax, count(*) AS n, string_agg(label::VARCHAR, ',' ORDER BY label) AS members FROM j2 GROUP BY 1, 2, 3, 4) SELECT row_number() OVER (ORDER BY h2, h1, h0) AS label, h0, h1, h2, {', '.join(map(joined_sql, range(3)))}, n, members FROM grp")
def q3(t: Tables) -> DataFrame:
    """Groups of 3 x 3 x 3 blocks that share a layer of blocks with the next group: ranges of blocks and of voxels, and the valid blocks (by label); groups without any are left out."""
    counts = {f"c{i}": grids.blocks_along(n, SIZE, OVERLAP) for i, n in enumerate(EXTENTS)}
    cells, names = [f"c{i}" for i in range(3)], ("h0", "h1", "h2")
    held = grids.in_blocks(kept_blocks(t).withColumns(counts), cells, JOINED, SHARED, grids.BLOCK, names)
    groups = held.groupBy(*names, *cells, "zmax").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("label")).cast("array<string>"), ",").alias("members"))  # 27 at most
    ends = {f"{name}{i}": v for i in range(3) for name, v in zip(("first", "last"), grids.bounds(f"h{i}", f"c{i}", JOINED, SHARED), strict=True)}
    places = {f"low{i}": (F.col(f"first{i}") - 1) * STEP + 1 for i in range(3)} | {f"high{i}": F.least((F.col(f"last{i}") - 1) * STEP + SIZE, grids.extent(n)) for i, n in enumerate(EXTENTS)}
    labelled = dense_labels(groups.withColumns(ends).withColumns(places).withColumn("at", grids.block_index(cells, JOINED, SHARED, names)), "at")
    return labelled.select("label", *names, *(f"{e}{i}" for i in range(3) for e in ("first", "last", "low", "high")), "n", "members")


#: The next level's blocks: half of the extent and of the overlap.
COARSE = SIZE - (OVERLAP + 1) // 2
COARSE_OVERLAP = (OVERLAP + 1) // 2
COARSE_STEP = COARSE - COARSE_OVERLAP


@query("q5_coarser_level", f"WITH {BLOCKS}, up AS (SELECT (g0 + 1) // 2 AS h0, (g1 + 1) // 2 AS h1, (g2 + 1) // 2 AS h2, zmax, count(*) AS children, string_agg(ind::VARCHAR, ',' ORDER BY ind) AS members, sum(share) / 8 AS share FROM blocks GROUP BY 1, 2, 3, 4) SELECT h0, h1, h2, {', '.join(f'(h{i} - 1) * {COARSE_STEP} + 1 AS low{i}, least((h{i} - 1) * {COARSE_STEP} + {COARSE}, ({n} + 1) // 2) AS high{i}' for i, n in enumerate(('24', '24', 'zmax')))}, children, members, round(share, 9) AS share FROM up")
def q5(t: Tables) -> DataFrame:
    """Blocks of half the resolution over up to eight blocks of the grid: bounds at that resolution, the children that hold mask voxels (by index) and their mean share, an empty place being 0."""
    half = lambda c: F.expr(f"({c} + 1) div 2")
    up = block_shares(t).groupBy(*(half(f"g{i}").alias(f"h{i}") for i in range(3)), half("zmax").alias("zhalf")).agg(F.count("*").alias("children"), F.array_join(F.sort_array(F.collect_list("ind")).cast("array<string>"), ",").alias("members"), (F.sum("share") / 8).alias("share"))  # 8 at most
    ends = {f"{name}{i}": v for i, n in enumerate((12, 12, "zhalf")) for name, v in zip(("low", "high"), grids.bounds(f"h{i}", n, COARSE, COARSE_OVERLAP), strict=True)}
    return up.withColumns(ends).select("h0", "h1", "h2", *ends, "children", "members", F.round("share", 9).alias("share"))


HALF = (OVERLAP + 1) // 2
CROP = " AND ".join(f"(g{i} = 1 OR {k} >= {low_sql(i)} + {HALF}) AND (g{i} = {COUNTS[i]} OR {k} < {low_sql(i)} + {STEP + HALF})" for i, k in enumerate("xyz"))


@query("v12_overlapped_patch_merge", f"WITH {HELD}, results AS (SELECT *, r::DOUBLE / max(r) OVER (PARTITION BY g0, g1, g2) AS value FROM held) SELECT x, y, z, g0, g1, g2, round(value, 6) AS value FROM results WHERE {CROP}")
def v12(t: Tables) -> DataFrame:
    """Results of overlapping patches (radius over the patch's greatest) in one volume: patches give up half of what they overlap on inner faces, in all three axes."""
    held = grids.in_blocks(with_extent(t), EXTENTS, SIZE, OVERLAP)
    most = held.groupBy(*grids.BLOCK).agg(F.max("r").alias("most"))
    merged = grids.cropped(held, EXTENTS, SIZE, OVERLAP).join(most, list(grids.BLOCK))
    return merged.select("x", "y", "z", *grids.BLOCK, r6(F.col("r").cast("double") / F.col("most")).alias("value"))


@query("v11_sphere_reconstruction", f"""WITH s AS (SELECT voxel_id, x, y, z, CASE WHEN r < {(1 + 2**0.5) / 2} THEN 0 WHEN r < {(2**0.5 + 2) / 2} THEN 1 WHEN r < {(2 + 5**0.5) / 2} THEN 2 WHEN r < {(5**0.5 + 3) / 2} THEN 3 ELSE greatest(CAST(floor(r + 0.5) AS BIGINT), 3) + 1 END AS rank FROM V),
o AS (SELECT rank, a.i AS dx, b.i AS dy, c.i AS dz FROM (SELECT DISTINCT rank FROM s) k, (SELECT unnest(range(-5, 6)) AS i) a, (SELECT unnest(range(-5, 6)) AS i) b, (SELECT unnest(range(-5, 6)) AS i) c WHERE CASE WHEN rank < 2 THEN dx * dx + dy * dy + dz * dz <= rank WHEN rank = 2 THEN greatest(abs(dx), abs(dy), abs(dz)) <= 1 WHEN rank = 3 THEN dx * dx + dy * dy + dz * dz <= 4 ELSE dx * dx + dy * dy + dz * dz <= (rank - 1) * (rank - 1) END),
p AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, max(rank * 1000000000000 + voxel_id) % 1000000000000 AS label FROM s JOIN o USING (rank) GROUP BY 1, 2, 3) SELECT * FROM p WHERE x BETWEEN 1 AND 24 AND y BETWEEN 1 AND 24 AND z BETWEEN 1 AND (SELECT max(z) FROM V)""")
def v11(t: Tables) -> DataFrame:
    """Every voxel paints the ball of its radius class inside the volume; the larger class, then the greater label, stays."""
    last = F.broadcast(t.V.agg(F.max("z").alias("zmax")))  # one row
    return grids.balls(t.V, "r", "voxel_id").crossJoin(last).where("x BETWEEN 1 AND 24 AND y BETWEEN 1 AND 24 AND z BETWEEN 1 AND zmax").drop("zmax")
