"""Regular grids of overlapping blocks in space: block g of an axis begins at (g - 1) * (size - overlap) + 1, the last one is clipped."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import AXES, whole_groups

Extent = int | str

BLOCK = ("g0", "g1", "g2")


def extent(n: Extent) -> Column:
    return F.lit(n).cast("long") if isinstance(n, int) else F.col(n)


def blocks_along(n: Extent, size: int, overlap: int) -> Column:
    """How many blocks an axis of ``n`` places (a number or a column) has."""
    return F.greatest(F.ceil((extent(n) - overlap) / (size - overlap)), F.lit(1).cast("long"))


def bounds(g: str, n: Extent, size: int, overlap: int) -> tuple[Column, Column]:
    """First and last place of block ``g``."""
    low = (F.col(g) - 1) * (size - overlap) + 1
    return low, F.least(low + (size - 1), extent(n))


def in_blocks(df: DataFrame, extents: Sequence[Extent], size: int, overlap: int, axes: Sequence[str] = AXES, names: Sequence[str] = BLOCK) -> DataFrame:
    """A row for each block that holds a row's place; places that are null or outside 1..extent are in none.

    A row's blocks follow from its place, so no table of blocks is joined.
    """
    step, out = size - overlap, df
    for k, n, g in zip(axes, extents, names, strict=True):
        at = F.col(k)
        first = F.greatest(F.ceil((at - size) / step) + 1, F.lit(1).cast("long"))
        last = F.least(F.floor((at - 1) / step) + 1, blocks_along(n, size, overlap))
        out = out.where(at.between(1, extent(n))).withColumn(g, F.explode(F.sequence(first, last)))
    return out


def block_index(extents: Sequence[Extent], size: int, overlap: int, names: Sequence[str] = BLOCK) -> Column:
    """One number for a block, the first axis running fastest."""
    a, b = (blocks_along(n, size, overlap) for n in extents[:2])
    return F.col(names[0]) + a * (F.col(names[1]) - 1) + a * b * (F.col(names[2]) - 1)


def cropped(df: DataFrame, extents: Sequence[Extent], size: int, overlap: int, axes: Sequence[str] = AXES, names: Sequence[str] = BLOCK) -> DataFrame:
    """Rows that stay when blocks give up half of what they overlap, so each place comes from one block; outer faces keep all."""
    half, out = (overlap + 1) // 2, df
    for k, n, g in zip(axes, extents, names, strict=True):
        low, _ = bounds(g, n, size, overlap)
        begins = (F.col(g) == 1) | (F.col(k) >= low + half)
        ends = (F.col(g) == blocks_along(n, size, overlap)) | (F.col(k) < low + (size - overlap + half))
        out = out.where(begins & ends)
    return out


def balls(voxels: DataFrame, radius: str, label: str) -> DataFrame:
    """x, y, z and the label that is painted there: every voxel paints the ball of its radius class; the larger class, then the greater label, stays.

    Classes are 1 (the voxel), the square root of 2 (its faces), 2 (a cube of 27), the square root
    of 5 (a ball of 2), then whole radii from 3, and a radius belongs to the nearest class (half
    way: the larger). Voxels without a radius, a place or a label paint nothing. Voxels (whole places and
    labels) are dealt to the tiles of space that their balls touch, and a tile is painted in one go:
    cells that several balls share are never rows.
    """
    r = F.col(radius).cast("double")
    edge = lambda a, b: (a + b) / 2
    two, five = 2**0.5, 5**0.5
    small = F.when(r < edge(1, two), 0).when(r < edge(two, 2), 1).when(r < edge(2, five), 2).when(r < edge(five, 3), 3)
    rank = F.coalesce(small, F.greatest(F.floor(r + 0.5), F.lit(3)) + 1).cast("long")
    rows = voxels.where(r.isNotNull() & ~F.isnan(r) & F.col(label).isNotNull()).select(*AXES, F.col(label).alias("label"), rank.alias("rank"))
    reach = F.when(F.col("rank") < 2, F.col("rank")).when(F.col("rank") == 2, 1).when(F.col("rank") == 3, 2).otherwise(F.col("rank") - 1)
    dealt = rows.select(*(F.col(c).cast("long").alias(c) for c in AXES), F.col("label").cast("long").alias("label"), "rank", reach.cast("long").alias("reach"))
    for i, c in enumerate(AXES):
        dealt = dealt.where(F.col(c).isNotNull()).withColumn(f"c{i}", F.explode(F.sequence(*(F.floor((F.col(c) + d * F.col("reach")) / TILE) for d in (-1, 1)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, TILES):
            tile = np.stack([table.column(c).to_numpy() for c in TILES], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1, [len(tile)]])
            place = np.stack([table.column(c).to_numpy() for c in AXES], axis=1) - tile * TILE
            rank, label = (table.column(c).to_numpy() for c in ("rank", "label"))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    at, found = _painted(place[a:b], rank[a:b], label[a:b])
                    yield pa.record_batch([*(pa.array(at[i] + tile[a, i] * TILE) for i in range(3)), pa.array(found)], names=[*AXES, "label"])

    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as few bytes are much to paint
    painted = dealt.repartition(parts, *TILES).sortWithinPartitions(*TILES).mapInArrow(run, "x long, y long, z long, label long")
    return painted.select(*(F.col(c).cast("long") for c in AXES), F.col("label").cast(voxels.schema[label].dataType).alias("label"))


#: Side of the tiles that balls are painted in, and the columns that name them.
TILE = 48
TILES = ("c0", "c1", "c2")


def _ball(rank: int) -> np.ndarray:
    """Offsets of a class's ball that can lie in one tile with its centre around it, a row each."""
    half = 1 if rank in (1, 2) else 2 if rank == 3 else rank - 1 if rank else 0
    steps = np.mgrid[-half : half + 1, -half : half + 1, -half : half + 1].reshape(3, -1).T
    return steps if rank == 2 else steps[(steps * steps).sum(axis=1) <= (rank if rank < 2 else 4 if rank == 3 else half * half)]


#: Offsets up to which a class's ball is laid out at once; those of wider ones are told in the tile.
WIDE = 20


def _painted(place: np.ndarray, rank: np.ndarray, label: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Places and labels of a tile's painted cells: classes in rising order, in each the greatest label."""
    shape = (TILE, TILE, TILE)
    done, out = np.zeros(TILE**3, bool), np.zeros(TILE**3, np.int64)
    cells = np.arange(TILE)
    for k in np.unique(rank).tolist():
        here = np.flatnonzero(rank == k)
        here = here[np.argsort(label[here], kind="stable")]  # of equal places the greatest label comes last
        if k <= WIDE:
            own, most = np.zeros(TILE**3, bool), np.zeros(TILE**3, np.int64)
            p, v = place[here], label[here]
            for step in _ball(k):
                q = p + step
                ok = ((q >= 0) & (q < TILE)).all(axis=1)
                flat, value = np.ravel_multi_index(tuple(q[ok].T), shape), v[ok]
                most[flat] = np.where(own[flat], np.maximum(most[flat], value), value)
                own[flat] = True
            out[own], done = most[own], done | own
        else:
            for i in here:
                x, y, z = ((cells - c) ** 2 for c in place[i])
                ball = ((x[:, None, None] + y[:, None] + z) <= (k - 1) ** 2).ravel()
                out[ball] = label[i]  # labels rise
                done |= ball
    flat = np.flatnonzero(done)
    return np.unravel_index(flat, shape), out[flat]
