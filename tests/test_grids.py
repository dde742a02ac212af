"""Overlapping blocks against plain loops, and painted balls by hand."""

from collections import Counter

import pytest

from netloom.operators import grids


def blocks(n, size, overlap):
    step = size - overlap
    return [(a, min(a + size - 1, n)) for a in range(1, max(n - overlap, 1) + 1, step)]


@pytest.mark.parametrize(("n", "size", "overlap"), [(24, 10, 2), (25, 10, 3), (7, 10, 2), (1, 4, 1), (13, 5, 1), (18, 10, 2), (12, 6, 4)])
def test_blocks_of_an_axis(spark, n, size, overlap):
    places = spark.createDataFrame([(x, 1, z) for x in range(-1, n + 3) for z in (1, 2)] + [(None, 1, 1)], "x int, y int, z int")
    rows = grids.in_blocks(places, (n, 1, 2), size, overlap)
    got = Counter((r.x, r.g0) for r in rows.where("z = 1").collect())
    assert got == Counter((x, g) for g, (a, b) in enumerate(blocks(n, size, overlap), 1) for x in range(a, b + 1))
    low, high = grids.bounds("g0", n, size, overlap)
    ends = {(r.g0, r.a, r.b) for r in rows.select("g0", low.alias("a"), high.alias("b")).collect()}
    assert ends == {(g, *ab) for g, ab in enumerate(blocks(n, size, overlap), 1)}


@pytest.mark.parametrize(("n", "size", "overlap"), [(24, 10, 2), (25, 10, 3), (7, 10, 2), (13, 5, 1)])
def test_cropping_leaves_each_place_once(spark, n, size, overlap):
    places = spark.createDataFrame([(x, y, 1) for x in range(1, n + 1) for y in range(1, 6)], "x int, y int, z int")
    ext = (n, 5, 1)
    kept = grids.cropped(grids.in_blocks(places, ext, size, overlap), ext, size, overlap)
    assert Counter((r.x, r.y) for r in kept.collect()) == Counter((x, y) for x in range(1, n + 1) for y in range(1, 6))


@pytest.mark.parametrize(("radius", "cells"), [(0.5, 1), (1.2, 1), (1.3, 7), (1.8, 27), (2.2, 33), (2.7, 123), (3.4, 123), (3.5, 257)])
def test_a_ball_of_each_class(spark, radius, cells):
    one = spark.createDataFrame([(0, 0, 0, radius, 5)], "x int, y int, z int, r double, label int")
    rows = grids.balls(one, "r", "label").collect()
    assert len(rows) == len({(r.x, r.y, r.z) for r in rows}) == cells and {r.label for r in rows} == {5}
    assert {(-r.z, r.x, r.y) for r in rows} == {(r.x, r.y, r.z) for r in rows}


def test_wider_balls_paint_over(spark):
    voxels = [(0, 0, 0, 3.0, 1), (2, 0, 0, 1.3, 9), (20, 0, 0, 1.3, 3), (21, 0, 0, 1.3, 4), (40, 0, 0, None, 7), (50, 0, 0, float("nan"), 7), (60, 0, 0, 1.0, None)]
    got = {(r.x, r.y, r.z): r.label for r in grids.balls(spark.createDataFrame(voxels, "x int, y int, z int, r double, label int"), "r", "label").collect()}
    assert got[2, 0, 0] == 1 and got[3, 0, 0] == 1 and got[2, 1, 0] == 1
    assert got[20, 0, 0] == 4 and got[21, 0, 0] == 4 and got[19, 0, 0] == 3
    assert max(x for x, _, _ in got) == 22
