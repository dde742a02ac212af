"""Hand-made voxel sets and link tables for chains, hairs and short paths."""

from netloom.operators import chains, paths

RING = [(2, 0), (1, 1), (0, 2), (-1, 1), (-2, 0), (-1, -1), (0, -2), (1, -1)]


def voxels(spark, places):
    return spark.createDataFrame([(i + 1, *map(int, p)) for i, p in enumerate(places)], "voxel_id long, x long, y long, z long")


def found(spark, places):
    return {r["voxel_id"]: (r["label"], r["pos"], r["size"]) for r in chains.chains(chains.neighbour_counts(voxels(spark, places))).collect()}


def test_line_and_single(spark):
    assert found(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (9, 9, 9)]) == {1: (1, 1, 3), 2: (1, 2, 3), 3: (1, 3, 3)}


def test_ring_has_no_order(spark):
    assert set(found(spark, [(*p, 0) for p in RING]).values()) == {(1, None, 8)}


def test_long_line(spark):
    got = found(spark, [(i, 0, 0) for i in range(40)])
    assert all(got[i] == (1, i, 40) for i in range(1, 41))


def test_junction_and_hairs(spark):
    arms = [(5, 5, 5)] + [tuple(5 + k * d for d in v) for v, n in (((1, 1, 1), 6), ((-1, -1, 1), 6), ((1, -1, -1), 2)) for k in range(1, n + 1)]
    rows = chains.incidence(voxels(spark, arms)).collect()
    assert sorted((r["size"], {r["node_a"], r["node_b"]} == {0, 1}) for r in rows) == [(2, True), (6, True), (6, True)]
    left = chains.prune_hairs(voxels(spark, arms), 3)
    assert left.count() == 13
    assert chains.incidence(left).count() == 1


def test_no_voxels(spark):
    assert chains.chains(chains.neighbour_counts(voxels(spark, []))).count() == 0


def test_theta_loops(spark):
    links = spark.createDataFrame([(1, 1, 2, 5.0), (2, 1, 2, 7.0), (3, 1, 2, 9.0), (4, 3, 3, 2.0), (5, 2, 4, 1.0)], "link_label long, node_a long, node_b long, length double")
    got = {r["link_label"]: (r["length"], r["n_edges"]) for r in paths.shortest_loops(links).collect()}
    assert got == {1: (12.0, 2), 2: (12.0, 2), 3: (14.0, 2), 4: (2.0, 1)}
