"""Hand-made cases for nearest labels, paths between pairs, displacements and removal."""

import numpy as np
import pytest

from netloom.operators import paths, spatial
from netloom.plans import fields, response


def brute(points, sources, k):
    found = {}
    for i, p in enumerate(points):
        near = {}
        for label, *s in sources:
            d = float(np.linalg.norm(np.array(p) - s))
            near[label] = min(d, near.get(label, np.inf))
        ranked = sorted((d, label) for label, d in near.items())[: k[i] if isinstance(k, list) else k]
        found[p] = [(label, round(d, 9)) for d, label in ranked]
    return found


def answer(df):
    got = {}
    for r in df.orderBy("place").collect():
        got.setdefault((r.x, r.y, r.z), []).append((r["label"], round(r.distance, 9)))
    return got


def tables(spark, points, sources):
    return spark.createDataFrame(points, "x double, y double, z double"), spark.createDataFrame(sources, "label long, x double, y double, z double")


@pytest.mark.parametrize("k", [1, 2])
def test_labels_with_many_sources(spark, k):
    r = np.random.default_rng(k)
    points = [tuple(map(float, p)) for p in {tuple(q) for q in r.integers(0, 60, (80, 3))}] + [(900.0, -700.0, 3.0), (-5000.0, 0.0, 0.0)]
    sources = [(int(i % 7), *map(float, p)) for i, p in enumerate(r.integers(0, 60, (60, 3)))] + [(3, 880.0, -700.0, 3.0), (3, 881.0, -700.0, 3.0)]
    assert answer(spatial.k_nearest(*tables(spark, points, sources), "label", k, 1.0)) == brute(points, sources, k)


def test_as_many_as_each_point_wants(spark):
    r = np.random.default_rng(5)
    points = [tuple(map(float, p)) for p in {tuple(q) for q in r.integers(0, 90, (40, 3))}] + [(4000.0, 0.0, 0.0)]
    want = [1 + i % 9 for i in range(len(points))]
    sources = [(i, *map(float, p)) for i, p in enumerate(r.integers(0, 90, (50, 3)))]
    given = spark.createDataFrame([(*p, w) for p, w in zip(points, want, strict=True)], "x double, y double, z double, want int")
    found = answer(spatial.k_nearest(given, tables(spark, points, sources)[1], "label", "want", 2.0, single=True))
    assert found == brute(points, sources, want)


def test_coordinates_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    points, sources = tables(spark, [(0.0, 0.0, 0.0), (nan, 1.0, 1.0), (1.0, inf, 1.0), (None, 1.0, 1.0)], [(4, 3.0, 4.0, 0.0), (5, nan, 0.0, 0.0), (6, 0.0, -inf, 0.0), (None, 0.0, 0.0, 0.0)])
    assert answer(spatial.k_nearest(points, sources, "label", 2, 1.0)) == {(0.0, 0.0, 0.0): [(4, 5.0)]}
    assert [(r.x, r["label"]) for r in spatial.nearest_source(points, sources, "label").collect()] == [(0.0, 4)]
    assert spatial.k_nearest(points, sources.where("label = 9"), "label", 2, 1.0).collect() == []


def test_paths_between_pairs(spark):
    """A long chain of short links beside one long link; two components; a node with itself."""
    links = [(i, i, i + 1, 1.0) for i in range(40)] + [(100, 0, 40, 39.5), (101, 50, 51, 7.0), (102, 5, 5, 1.0), (103, 3, 4, 0.25)]
    df = spark.createDataFrame(links, "link_label long, node_a long, node_b long, length double")
    pairs = spark.createDataFrame([(0, 40), (0, 39), (0, 20), (50, 51), (0, 50), (7, 7), (0, 999), (3, 4)], "a long, b long")
    got = {(r.a, r.b): (r.length, r.hops) for r in paths.shortest_between(pairs, df).collect()}
    assert got == {(0, 40): (39.25, 40), (0, 39): (38.25, 39), (0, 20): (19.25, 20), (50, 51): (7.0, 1), (7, 7): (0.0, 0), (3, 4): (0.25, 1)}


def test_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(i + 1, i) for i in range(9)] + [(20, 21), (21, 20)], "u long, v long")
    starts = spark.createDataFrame([("a", 0), ("a", 6), ("b", 20)], "search string, node long")
    goals = spark.createDataFrame([("a", 4), ("a", 9), ("a", 0), ("a", 20), ("b", 21), ("b", 3)], "search string, goal long")
    got = {(r.search, r.goal): r.hops for r in paths.hops_between(starts, goals, edges).collect()}
    assert got == {("a", 4): 2, ("a", 9): 3, ("a", 0): 0, ("b", 21): 1}


def test_one_deviating_displacement(spark):
    """Points of a grid move alike but for one, which moves the other way, and one of another tile, which has no neighbour."""
    rows = [(0, 10 * i + j, 10.0 * i, 10.0 * j, 5.0 + 0.01 * i, 1.0) for i in range(6) for j in range(6)]
    rows[14] = (*rows[14][:4], -5.0, 1.0)
    rows[20] = (*rows[20][:4], 25.0, 5.0)  # same way, but much longer: others differ by 0.8 of it
    df = spark.createDataFrame([*rows, (1, 99, 0.0, 0.0, 1.0, 1.0)], "tile long, id long, x double, y double, dx double, dy double")
    out = {r.id: r for r in fields.smoothness(df).collect()}
    assert {i for i, r in out.items() if r.outlier} == {rows[14][1], rows[20][1], 99}
    assert (out[0].n, out[0].cosine_mode, out[0].deviation_mode, round(out[0].mean_deviation, 6)) == (5, 1.0, 1.0, 0.9)
    assert out[rows[20][1]].deviation_mode == 0.4 and (out[99].n, out[99].cosine_mode, out[99].mean_deviation) == (0, -1.0, None)


def test_alignment_finds_a_shift(spark):
    r = np.random.default_rng(2)
    one = [(i, int(i >= 30), *map(float, p)) for i, p in enumerate(r.uniform(0, 100, (60, 3)))]
    two = [(100 + i, t, x + 5, y - 4, z + 3) for i, t, x, y, z in one] + [(500, 0, 200.0, 0.0, 0.0), (501, 7, 1.0, 1.0, 1.0)]
    a, b = (spark.createDataFrame(rows, "node long, tile long, x double, y double, z double") for rows in (one, two))
    expected = a.select("tile").distinct().selectExpr("tile", "0.0D AS dx", "0.0D AS dy", "0.0D AS dz")
    pairs = fields.aligned(a, b, expected, rounds=3)
    found = pairs.where("d < 1").collect()
    assert {(x.tile, x.a, x.b) for x in found} == {(t, i, 100 + i) for i, t, *_ in one}
    rates = {x.tile: (x.n, round(x.rate, 4)) for x in fields.match_rates(pairs, 1.0).collect()}
    assert rates == {0: (30, 1.0), 1: (30, 1.0)}


def test_removal_of_a_link(spark):
    """Three parallel lines at one height; removal of the middle one gives its cells to both sides."""
    lines = [(1000 * k + i + 1, 3 * i, 10 * k, 0) for k in range(3) for i in range(5)]
    chain = [(v + 100 * j, x + j, y, z) for v, x, y, z in lines for j in range(3) if x + j <= 12]
    voxels = spark.createDataFrame(chain, "voxel_id long, x long, y long, z long")
    cells = spark.createDataFrame([(x, y, 0) for x in range(3, 10) for y in (7, 8, 9, 11, 12)], "x long, y long, z long")
    mask, incidence = response.labelled_mask(voxels)
    rows = response.removal(cells, mask, 1.0).where("label = 1001 AND NOT own").collect()
    assert len(rows) == 35 and {(r.y, r.before, r.taker, r.after) for r in rows} == {(7, 3.0, 1, 7.0), (8, 2.0, 1, 8.0), (9, 1.0, 1, 9.0), (11, 1.0, 2001, 9.0), (12, 2.0, 2001, 8.0)}
    shares = {r.taker: round(r.share, 6) for r in response.taker_shares(response.removal(cells, mask, 1.0).where("label = 1001"), incidence).collect()}
    assert shares == {1: round((21 + 13) / 48, 6), 2001: round(14 / 48, 6)}


def test_a_node_s_cells_go_to_its_links(spark):
    counts = spark.createDataFrame([(1, t) for t in [2] * 6 + [3] * 2 + [-50] * 4 + [-60] * 5], "label long, taker long")
    incidence = spark.createDataFrame([(1, 50, 70), (2, 50, 0), (3, 50, 0), (4, 50, 0), (5, 60, 0)], "label long, node_a long, node_b long")
    shares = {r.taker: r.share for r in response.taker_shares(counts, incidence).collect()}
    assert shares == {2: 8 / 12, 3: 4 / 12}
    orders = {r.taker: r.branch_order for r in response.taker_orders(spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "label long, taker long"), incidence).collect()}
    assert orders == {2: 1, 3: 1, 5: None}
