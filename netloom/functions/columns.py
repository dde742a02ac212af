"""Column functions: coordinates, boxes, scaling, derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def subscripts(index: Column, size: Sequence[int]) -> list[Column]:
    """1-based subscripts of a 1-based, column-major linear index."""
    out, rest = [], index - 1
    for n in size[:-1]:
        out.append(rest % n + 1)
        rest = F.floor(rest / n)
    return [*out, rest + 1]


def linear_index(subs: Sequence[Column], size: Sequence[int]) -> Column:
    """1-based, column-major linear index of 1-based subscripts."""
    out, step = subs[0], 1
    for sub, n in zip(subs[1:], size, strict=False):
        step *= n
        out = out + (sub - 1) * step
    return out


def to_global(local: Column, low: Column) -> Column:
    return local + low - 1


def to_local(whole: Column, low: Column) -> Column:
    return whole - low + 1


def all_of(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def any_of(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def in_box(subs: Sequence[Column], low: Sequence[int], high: Sequence[int]) -> Column:
    """Inside a box, ends included; an inverted box holds nothing."""
    return all_of([s.between(a, b) for s, a, b in zip(subs, low, high, strict=True)])


def on_box_edge(subs: Sequence[Column], low: Sequence[int], high: Sequence[int]) -> Column:
    return any_of([(s == a) | (s == b) for s, a, b in zip(subs, low, high, strict=True)])


def near_face(subs: Sequence[Column], size: Sequence[int], offset: int) -> Column:
    """Within ``offset`` of a face of a volume."""
    return any_of([(s <= offset) | (s > n - offset) for s, n in zip(subs, size, strict=True)])


def rescale(sub: Column, scale: float, size: int) -> Column:
    """A coordinate scaled, rounded half away from zero and clamped to 1..size."""
    return F.least(F.greatest(F.round(sub * scale).cast("long"), F.lit(1)), F.lit(size))


def tile_address(sub: Column, voxel: float, tile_voxel: float, tile_size: int, n_tiles: int) -> tuple[Column, Column]:
    """Tile number and subscript in the tile of a grid coordinate."""
    at = F.least(F.greatest(F.round(sub * voxel / tile_voxel).cast("long"), F.lit(1)), F.lit(tile_size * n_tiles))
    tile = F.ceil(at / tile_size)
    return tile, at - (tile - 1) * tile_size


def pixel_to_um(pixel: Column, spacing: float, level: int, origin: float) -> Column:
    return (pixel - 0.5) * (spacing / 2**level) + origin


def normalised_difference(a: Column, b: Column, absolute: bool = False) -> Column:
    out = 2 * (a - b) / (a + b)
    return F.abs(out) if absolute else out


def array_summary(values: Column) -> tuple[Column, Column, Column]:
    """Least, median (of two or more) and greatest of an array column."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.array_min(values), F.when(n >= 2, (low + high) / 2), F.array_max(values)


def cosines_to_degrees(values: Column) -> Column:
    return F.transform(values, lambda c: F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))))
