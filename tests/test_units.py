"""Hand-made cases for sources, trees, statistics and graphs."""

from pyspark.sql import functions as F

from netloom.operators import graph, moments, paths, spatial, stats, trees
from netloom.plans import fields, refinement
from netloom.sources import files


def test_percentiles_of_four(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(float("nan"),), (None,)], "v double")
    got = {r.level: r.percentile for r in stats.midpoint_percentiles(df, [], "v", (25, 50, 75)).collect()}
    assert got == {25: 1.5, 50: 2.5, 75: 3.5}
    assert stats.nearest_percentiles(df, [], "v", (0.25, 0.5, 0.75)).first()[:] == (1.0, 2.0, 3.0)


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 2.0, 2.1, float("nan"))] + [(None,)], "v double")
    got = [r.b for r in df.select("v", stats.bin_of(F.col("v"), [0.0, 1.0, 2.0]).alias("b")).collect()]
    assert got == [None, 0, 1, 1, None, None, None]


def test_y_junction(spark):
    arms = [(d * k, s * k, t * k) for d, s, t in ((1, 1, 1), (-1, -1, 1), (1, -1, -1)) for k in (1, 2, 3)]
    voxels = spark.createDataFrame([(i, *p) for i, p in enumerate([(0, 0, 0), *arms])], "voxel_id long, x long, y long, z long")
    degree = {r.u: r["count"] for r in spatial.neighbours(voxels, "voxel_id").groupBy("u").count().collect()}
    assert sorted(degree.values()) == [1, 1, 1, 2, 2, 2, 2, 2, 2, 3]


def test_chain_and_loop_contract(spark):
    links = spark.createDataFrame([(1, 10, 11, 1.0), (2, 11, 12, 2.0), (3, 12, 13, 4.0), (4, 13, 14, 1.0), (5, 13, 15, 1.0)], "link_label long, node_a long, node_b long, length double")
    got = {r.link_label: (r.node_a, r.node_b, r.length, r.n_links) for r in graph.contract(links).collect()}
    assert got[1] == (10, 13, 7.0, 3) and set(got) == {1, 4, 5}


def test_double_edge_and_triangle(spark):
    links = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 1, 7.0), (3, 2, 3, 1.0), (4, 1, 3, 9.0), (5, 3, 3, 2.0)], "link_label long, node_a long, node_b long, length double")
    assert [(r.u, r.v, r.n, r.labels, r.length) for r in graph.parallel_links(links).collect()] == [(1, 2, 2, [1, 2], 12.0)]
    assert [(r.a, r.b, r.c, r.longest) for r in graph.triangles(links, "length").collect()] == [(1, 2, 3, 4)]


def test_eigenvalues(spark):
    rows = [(2.0, 0.0, 0.0, 1.0, 0.0, 3.0), (1.0, 0.0, 0.0, 1.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in moments.SIX))
    got = df.select(*(v.alias(f"e{i}") for i, v in enumerate(moments.eigenvalues([F.col(k) for k in moments.SIX])))).collect()
    for row, want in zip(got, ((3, 2, 1), (1, 1, 1), (3, 0, 0)), strict=True):
        assert all(abs(a - b) < 1e-6 for a, b in zip(row, want, strict=True))


def test_quadratic(spark):
    df = spark.createDataFrame([("a", float(x), 2 - 3.0 * x + 0.5 * x * x) for x in range(6)], "k string, x double, y double")
    row = moments.quadratic(df, ["k"], F.col("x"), F.col("y")).first()
    assert all(abs(a - b) < 1e-6 for a, b in zip(row[2:], (2, -3, 0.5), strict=True))


def test_tree_branches(spark):
    nodes = [(1, 1, 0.0, 0.0, 0.0, -1), (1, 2, 1.0, 0.0, 0.0, 1), (1, 3, 2.0, 0.0, 0.0, 2), (1, 4, 3.0, 0.0, 0.0, 3), (1, 5, 2.0, 1.0, 0.0, 3)]
    df = spark.createDataFrame(nodes, "tree long, id long, x double, y double, z double, parent long")
    got = {r.branch: (r.n, r.length, r.leaf, r.parent_branch) for r in trees.branch_table(df).collect()}
    assert got == {1: (1, 0.0, False, None), 3: (2, 2.0, False, 1), 4: (1, 1.0, True, 3), 5: (1, 1.0, True, 3)}
    assert trees.prune_leaves(df, 2.0).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.swc").write_text("# OFFSET 10 20 30\n1 0 1 2 3 0.5 -1\n2 0 2 2 3 0.5 1\n")
    (tmp_path / "b.swc").write_text("1 0 1 1 1 1 -1\n")
    rows = sorted((r.id, r.x, r.y, r.z, r.parent) for r in files.read_trees(spark, str(tmp_path / "*.swc")).collect())
    assert rows == [(1, 1.0, 1.0, 1.0, -1), (1, 11.0, 22.0, 33.0, -1), (2, 12.0, 22.0, 33.0, 1)]
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "c.txt").write_text("1 2 3 0.5 0.25\n4 5 6 1 2\n")
    assert [(r.x, r.f1) for r in files.read_descriptors(spark, str(tmp_path / "points")).orderBy("x").collect()] == [(1.0, 0.25), (4.0, 2.0)]
    for i, text in enumerate(("x: 1\ny: 1\nz: 1\nx_mm: 0.0\ny_mm: 0\nz_mm: 0", "x_mm: 0.5\ny_mm: 0\nz_mm: 0\ncut_count: 3", "x_mm: 1.0\ny_mm: 0\nz_mm: 0")):
        (tmp_path / "acq" / str(i)).mkdir(parents=True)
        (tmp_path / "acq" / str(i) / "tile.acquisition").write_text(text)
    assert sorted(((r.gx, r.gy, r.cut) for r in files.read_acquisition(spark, str(tmp_path / "acq")).collect()), key=str) == [(1, 1, None), (2, 1, 3), (3, 1, None)]
    table = spark.createDataFrame([("d", "s1", 1, 1.0), ("d", "s2", 2, float("nan"))], "dataset string, stack string, region int, v double")
    files.write_analysis(table, str(tmp_path / "t"))
    files.write_analysis(table.where("stack = 's2'").withColumn("v", F.lit(5.0)), str(tmp_path / "t"))
    assert [(r.region, r.v) for r in files.read_analysis(spark, str(tmp_path / "t"), dataset="d", stack="s2").collect()] == [(2, 5.0)]
    assert files.read_analysis(spark, str(tmp_path / "t")).count() == 2
    files.write_region_csv(table, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/all"), header=True).count() == 2 and spark.read.csv(str(tmp_path / "csv/finite"), header=True).count() == 1


def test_large_and_small_stars(spark):
    """A chain of 300, a star of 200, a pair, a loop and a node by itself."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 201)] + [(2001, 2000), (3000, 3000)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(201)} | {2000: 2000, 2001: 2000, 3000: 3000}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_shortest_loops_of_many_links(spark):
    """A ring of eight short links is shorter than the way by two long ones."""
    ring = [(i, i, (i + 1) % 8, 1.0) for i in range(8)] + [(100, 0, 50, 30.0), (101, 50, 4, 30.0), (102, 9, 9, 2.0), (103, 60, 61, 1.0)]
    df = spark.createDataFrame(ring, "link_label long, node_a long, node_b long, length double")
    got = {r.link_label: (r.length, r.n_edges) for r in paths.shortest_loops(df).collect()}
    assert got == {i: (8.0, 8) for i in range(8)} | {100: (64.0, 6), 101: (64.0, 6), 102: (2.0, 1)}


def test_nearest_however_far(spark):
    points = spark.createDataFrame([(0.0, 0.0, 0.0), (5000.0, 0.0, 0.0), (3.0, 4.0, 0.0)], "x double, y double, z double")
    sources = spark.createDataFrame([(7, 0.0, 0.0, 1.0), (5, 0.0, 1.0, 0.0)], "id long, x double, y double, z double")
    got = {r.x: (r.id, round(r.distance, 3)) for r in spatial.nearest_source(points, sources, "id", 1).collect()}
    assert got == {0.0: (5, 1.0), 5000.0: (5, 5000.0), 3.0: (5, 4.243)}
    assert spatial.nearest_source(points, sources.where("id > 9"), "id").collect() == []


def test_ranks_in_parts(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, float(i * i % 997)) for i in range(3000)], "k string, v double")
    for keys in (["k"], []):
        rows = [(r["k"] if keys else 0, r.v, r.c, r.first, r.last, r.n) for r in stats._ranked(df, keys, "v").collect()]
        for k in {r[0] for r in rows}:
            own = sorted(float(i * i % 997) for i in range(3000) if not keys or ("a" if i % 3 else None) == k)
            assert sorted(r[1:] for r in rows if r[0] == k) == [(v, own.count(v), own.index(v) + 1, own.index(v) + own.count(v), len(own)) for v in sorted(set(own))]


def test_clean_up_ends(spark):
    """A stub falls, the chain it hung on becomes one link; of a weak pair one goes."""
    rows = [(1, 1, 2, 5.0, 30, 9), (2, 2, 3, 5.0, 30, 9), (3, 2, 9, 1.0, 2, 5), (4, 3, 4, 5.0, 10, 3), (5, 3, 4, 6.0, 40, 8), (6, 4, 5, 9.0, 60, 9), (7, 4, 6, 9.0, 60, 9), (8, 1, 7, 9.0, 60, 9), (9, 1, 8, 9.0, 60, 9)]
    df = spark.createDataFrame(rows, "link_label long, node_a long, node_b long, length double, n_voxel long, intensity long")
    left, audit = refinement.clean_up(df)
    assert sorted((r["round"], r.kind, r.n) for r in audit.collect()) == [(1, "hair", 1), (1, "parallel", 1)]
    assert sorted((r.link_label, r.length) for r in left.collect()) == [(1, 16.0), (6, 9.0), (7, 9.0), (8, 9.0), (9, 9.0)]


def test_axis_of_points(spark):
    df = spark.createDataFrame([(1, float(k), 2.0 * k, 2.0 * k) for k in range(-3, 4)], "g int, x double, y double, z double")
    row = refinement.axes(df, ["g"]).first()
    assert all(abs(abs(row[f"u{k}"]) - v) < 1e-6 for k, v in (("x", 1 / 3), ("y", 2 / 3), ("z", 2 / 3)))


def test_affine_of_tiles(spark):
    rows = [(1, *p, *(sum(a * b for a, b in zip(m, p, strict=True)) for m in ((0.1, 0, 0.02), (0, 0.2, 0), (0.01, 0, 0.3)))) for p in ((200.0, 1.0, 0.0), (0.0, 180.0, 2.0), (3.0, 0.0, 150.0), (-200.0, -1.0, 0.0))]
    row = fields.affine(spark.createDataFrame(rows, "tile int, p0 double, p1 double, p2 double, s0 double, s1 double, s2 double"), "tile").first()
    assert [round(v, 9) for v in row[2:]] == [0.1, 0, 0.02, 0, 0.2, 0, 0.01, 0, 0.3]
