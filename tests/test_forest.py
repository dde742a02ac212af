"""Forests, bridges, merge trees, guarded deletion, ball counts and pair sums against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import deletion, forest, moments, spatial
from netloom.plans import comparison, refinement


def graph_of(seed, n, m):
    r = np.random.default_rng(seed)
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(r.integers(1, n + 1, (m, 2)))]


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for _, a, b in edges:
            for p, q in ((a, b), (b, a)):
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
    return seen


LINKS = "link_label long, node_a long, node_b long"


@pytest.mark.parametrize("edges", [graph_of(1, 40, 45), [(i, i + 1, i + 2) for i in range(30)] + [(90, 5, 12), (91, 1, 1), (92, 20, 21)], [(i, 1, i + 2) for i in range(20)] + [(50, 3, 4)]])
def test_forest_and_bridges(spark, edges):
    df = spark.createDataFrame(edges, LINKS)
    want = {i for i, a, b in edges if a != b and b not in reach([e for e in edges if e[0] != i], a)}
    assert {r.link_label for r in forest.bridges(df).collect()} == want
    taken = {r.id for r in forest.spanning_forest(df.toDF("id", "u", "v")).collect()}
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    least = set()
    for i, a, b in sorted(edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            least.add(i)
    assert taken == least


def test_no_bridges(spark):
    assert forest.bridges(spark.createDataFrame([(1, 2, 2)], LINKS)).collect() == []
    assert forest.bridges(spark.createDataFrame([], LINKS)).collect() == []


@pytest.mark.parametrize("hub", [False, True])
def test_merge_tree(spark, hub):
    r = np.random.default_rng(4)
    edges = [(i, 1 if hub and i % 2 else a, b) for i, a, b in graph_of(3, 30, 34)]
    rows = [(*e, int(r.integers(6)), float(e[0])) for e in edges]
    df = spark.createDataFrame(rows, LINKS + ", step int, length double")
    got = sorted((x.step, x.nodes, x.links, x.length) for x in comparison.component_steps(df, 6).collect())
    want = []
    for step in range(6):
        kept = [e for e in rows if e[3] <= step]
        left = {x for e in kept for x in e[1:3]}
        while left:
            part = reach([e[:3] for e in kept], min(left))
            own = [e for e in kept if e[1] in part]
            want.append((step, len(part), len(own), sum(e[4] for e in own)))
            left -= part
    assert got == sorted(want)


def test_core_steps(spark):
    rows = [(1, 1, 2, 0), (2, 2, 3, 0), (3, 3, 1, 2), (4, 3, 4, 0), (5, 4, 5, 1), (6, 5, 4, 3), (7, 9, 9, 1), (8, 6, 7, 0)]
    df = spark.createDataFrame(rows, LINKS + ", step int")
    assert {r.link_label: r.step for r in forest.core_steps(df, 4).collect()} == {1: 2, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3, 7: 1}


def in_order(links, selected):
    """One deletion after another."""
    now = {i: [a, b, n] for i, a, b, n in links}
    state = {i: i for i in now}
    report = {}
    for s in selected:
        if s not in state:
            report[s] = "gone"
            continue
        if state[s] != s or now[s][2] != dict((x[0], x[3]) for x in links)[s]:
            report[s] = "changed"
            continue
        degree = lambda v: sum((x[0] == v) + (x[1] == v) for x in now.values())
        nodes = [v for v in now[s][:2] if v > 0]
        if not nodes:
            report[s] = "without nodes"
        elif any(degree(v) < 3 for v in nodes):
            report[s] = "endpoint"
        else:
            report[s] = "deleted"
            del now[s]
            for v in sorted(set(nodes)):
                at = [k for k, x in now.items() if v in x[:2]]
                if degree(v) == 2:
                    tips = [t for k in at for t in now[k][:2] if t != v]
                    size, label = sum(now[k][2] for k in at) + 1, min(at)
                    for k in at:
                        del now[k]
                    now[label] = [*(tips + [0, 0])[:2], size]
                    state |= {k: -1 for k in at}
                    state = {k: (label if state[k] in at else state[k]) for k in state} | {k: -1 for k in at}
                elif degree(v) == 1:
                    now[at[0]] = [0 if t == v else t for t in now[at[0]][:2]] + [now[at[0]][2]]
    return sorted((*sorted(x[:2]), x[2]) for x in now.values()), report


@pytest.mark.parametrize("seed, n, m", [(1, 12, 24), (2, 20, 30), (3, 6, 14), (4, 30, 40)])
def test_guarded_delete(spark, seed, n, m):
    r = np.random.default_rng(seed)
    links = [(i, a if a % 11 else 0, b, int(r.integers(1, 9))) for i, a, b in graph_of(seed, n, m)] + [(500, 0, 0, 3)]
    selected = [int(i) for i in r.permutation(m)[: m // 2]] + [500, 999]
    left, report = deletion.guarded_delete(spark.createDataFrame(links, LINKS + ", size long"), spark.createDataFrame([(s, k) for k, s in enumerate(selected)], "link_label long, ord long"))
    want_left, want = in_order(links, selected)
    assert {x.link_label: x.status for x in report.collect()} == want
    assert sorted((*sorted((x.node_a, x.node_b)), x["size"]) for x in left.collect()) == want_left


def test_counts_in_balls(spark):
    r = np.random.default_rng(8)
    points = r.uniform(0, 100, (300, 3)).round(1).tolist() + [[50.0, 50.0, 50.0]] * 40 + [[900.0, 0.0, 0.0], [float("nan"), 1.0, 1.0]]
    balls = [(i, *points[i], float(d)) for i, d in enumerate(r.uniform(0, 60, 30).round(1))] + [(100, 50.0, 50.0, 50.0, 0.0), (101, 0.0, 0.0, 0.0, 2000.0), (102, 5000.0, 0.0, 0.0, 10.0), (103, 1.0, 1.0, 1.0, None), (104, 50.0, 50.0, 40.0, 10.0)]
    got = {x.id: x.nearer for x in spatial.count_nearer(spark.createDataFrame(balls, "id int, x double, y double, z double, far double"), spark.createDataFrame(points, "x double, y double, z double"), "far").collect()}
    with np.errstate(invalid="ignore"):
        assert got == {i: 0 if d is None else int((np.sqrt(((np.array(points) - [x, y, z]) ** 2).sum(axis=1)) < d).sum()) for i, x, y, z, d in balls}


def test_regressions_over_common_rows(spark):
    r = np.random.default_rng(9)
    a = r.normal(1e6, 1, 200)
    x = np.stack([a, 3 * a + r.normal(size=200), r.normal(size=200), np.ones(200)], axis=1)
    rows = [[None if r.random() < 0.2 else float(v) for v in row] for row in x] + [[float("nan"), float("inf"), 1.0, None]]
    got = {(g.a, g.b): g for g in moments.all_regressions(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3), list("abcd")).collect()}
    assert set(got) == {(p, q) for p in "abc" for q in "abc" if p != q}
    for (p, q), g in got.items():
        both = np.array([(row["abcd".index(p)], row["abcd".index(q)]) for row in rows if None not in (row["abcd".index(p)], row["abcd".index(q)]) and np.isfinite([row["abcd".index(p)], row["abcd".index(q)]]).all()])
        slope, intercept = np.polyfit(both[:, 0] - both[:, 0].mean(), both[:, 1], 1)
        assert g.n == len(both) and g.r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9) and g.slope == pytest.approx(slope, abs=1e-8)
        assert g.intercept + g.slope * both[:, 0].mean() == pytest.approx(intercept, abs=1e-6)


def test_leaf_branches(spark):
    """A short branch goes, unless a free end of another object's long branch is near."""
    line = lambda base, y, n, x0=0: [(base + i, x0 + i, y, 0) for i in range(n)]
    voxels = line(1, 0, 3) + line(100, 4, 8, 1) + line(200, 30, 3) + line(300, 34, 5) + line(400, 60, 4) + line(500, 66, 9)
    found = {r.label: r["size"] for r in refinement.leaf_branches(spark.createDataFrame(voxels, "voxel_id long, x long, y long, z long"), 5).collect()}
    assert found == {200: 3, 400: 4}


def test_top_of_a_step_in_parts(spark):
    df = spark.range(5000).select(F.lit(1).alias("step"), F.col("id").alias("component"), (F.col("id") * 7919 % 5000).alias("nodes"))
    assert sorted(r.nodes for r in comparison.largest(df, ["step"], "nodes").collect()) == list(range(4990, 5000))
