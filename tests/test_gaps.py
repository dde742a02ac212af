"""Walks over gaps: hand-made voxels with known answers."""

import math

import pytest

from netloom.operators import chains, gaps


def walk(spark, a, b):
    pairs = spark.createDataFrame([(1, 2, *a, *b)], "a long, b long, ax long, ay long, az long, bx long, by long, bz long")
    return gaps.walks(pairs)


@pytest.mark.parametrize(("a", "b"), [((1, 1, 1), (6, 1, 1)), ((1, 1, 1), (4, 9, 3)), ((9, 9, 9), (2, 7, 4)), ((3, 3, 3), (3, 3, 3))])
def test_walks_touch_and_never_return(spark, a, b):
    rows = [(r.x, r.y, r.z) for r in walk(spark, a, b).orderBy("k").collect()]
    assert rows[0] == a and rows[-1] == b and len(set(rows)) == len(rows) == 1 + max(abs(p - q) for p, q in zip(a, b, strict=True))
    for p, q in zip(rows, rows[1:]):
        assert max(abs(i - j) for i, j in zip(p, q, strict=True)) == 1


def test_features_of_a_gap(spark):
    """Two lines along x with a gap from 3 to 9, and a voxel of a third link near its middle."""
    voxels = [(x, x, 5, 5, 1.5, 1) for x in (1, 2, 3)] + [(x, x, 5, 5, 0.5, 2) for x in (9, 10)] + [(50, 6, 7, 5, 2.5, 3)]
    table = spark.createDataFrame(voxels, "voxel_id long, x long, y long, z long, r double, link long")
    met = gaps.met(walk(spark, (3, 5, 5), (9, 5, 5)), table, 4)
    near = {r.x: (r.link, r.distance) for r in met.collect()}
    assert near[3] == (1, 0) and near[4] == (1, 1) and near[6] == (3, 2) and near[9] == (2, 0)
    assert near[5] == (1, 2) and near[7] == (2, 2)  # of equally near voxels the least id: 3 before 50, 9 before 50
    f = gaps.features(met).first()
    # ratios: 0, 2/3, 4/3, 4/5, 4, 2, 0; inside: yes, yes, no, yes, no, no, yes
    assert (f["n"], f["length"], f["links"], f["entries"]) == (7, 7.0, 3, 4)
    assert f["outside"] == pytest.approx(3 / 7) and f["mean"] == pytest.approx(2 / 7) and f["outside_mean"] == 0
    assert f["ratio_mean"] == pytest.approx((2 / 3 + 4 / 3 + 4 / 5 + 6) / 7)
    assert f["turns"] == 3  # grows: yes, yes, no, yes, no, no
    assert tuple(f["last"]) == (5, 8, 5, 5)


def test_where_a_chain_points(spark):
    line = [(x, x, 5, 5) for x in range(1, 13)] + [(20, 20, 20, 20), (21, 21, 21, 20)]
    voxels = spark.createDataFrame(line, "voxel_id long, x long, y long, z long")
    counted = chains.neighbour_counts(voxels)
    placed = chains.chains(counted).join(counted, "voxel_id")
    got = {r.voxel_id: r for r in gaps.chain_ends(placed, 4).collect()}
    assert set(got) == {1, 12, 20, 21} and all(r.both_free for r in got.values())
    assert (got[1].ox, got[12].ox, got[12].oy) == (-1, 1, 0) and got[20].ox is None
    assert got[12].size == 12 and math.isclose(got[1].ox ** 2 + got[1].oy ** 2 + got[1].oz ** 2, 1)
