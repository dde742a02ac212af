"""Findings of the third round on time and disk: the work of a step follows its input."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest

from netloom.operators import forest, grids, learning, paths
from netloom.plans import QUERIES
from netloom.sources import files

LINKS = "link_label long, node_a long, node_b long, length double"
TABLES = "/root/testdata/sf0.001"


def recorded(monkeypatch, module):
    """Numbers of rows that the module's steps write."""
    plain, sizes = module.checkpointed, []

    def noted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "checkpointed", noted)
    return sizes


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def loop(links, label):
    """The shortest loop through a link: length, number of links and path, of equally short ones the least."""
    a, b, own = next((u, v, s) for k, u, v, s in links if k == label)
    around = defaultdict(list)
    for k, u, v, s in links:
        if k != label:
            around[u].append((v, k, s))
            around[v].append((u, k, s))
    open_, done = [(0.0, 0, (), a)], set()
    while open_:
        length, hops, path, at = heapq.heappop(open_)
        if at == b:
            return own + length, hops + 1, [label, *path]
        if at not in done:
            done.add(at)
            for v, k, s in around[at]:
                heapq.heappush(open_, (length + s, hops + 1, (*path, k), v))
    return None


def test_loops_are_searched_once_a_node(spark, monkeypatch):
    """Ties, parallel links, bridges: rows follow the nodes' balls and not links times nodes."""
    draw = random.Random(3)
    links = [(i, *draw.sample(range(40), 2), float(draw.randrange(1, 9))) for i in range(160)] + [(200, 7, 7, 2.0), (201, 3, 60, 1.0), (202, 60, 61, 1.0)]
    sizes = recorded(monkeypatch, paths)
    got = {r.link_label: (r.length, r.n_edges, list(r.path)) for r in paths.shortest_loops(spark.createDataFrame(links, LINKS).repartition(3)).collect()}
    want = {k: found for k, u, v, _ in links if u != v and (found := loop(links, k))}
    assert got == {**want, 200: (2.0, 1, [200])} and 201 not in got
    assert max(sizes) < 160 * 40 / 2


def test_core_steps_stay_a_row_a_link(spark, monkeypatch):
    """No link is written once for each step; loops hold themselves, chains between cycles stay."""
    rows = [(i, i, i % 6 + 1, i % 3) for i in range(1, 7)] + [(10, 6, 20, 0), (11, 20, 21, 5), (12, 21, 21, 30), (13, 20, 22, 0), (14, 30, 31, 1), (15, 30, 31, 40)]
    sizes = recorded(monkeypatch, forest)
    df = spark.createDataFrame([(k, a, b, 1.0, s) for k, a, b, s in rows], LINKS + ", step int")
    got = {r.link_label: r.step for r in forest.core_steps(df, 50).collect()}
    assert got == {**{i: 2 for i in range(1, 7)}, 10: 30, 11: 30, 12: 30, 14: 40, 15: 40}
    assert max(sizes) <= len(rows) + 12


def test_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a").write_text("x_mm: 1\ny_mm: 1\nz_mm: 1\n")
    (tmp_path / "b").write_text("x_mm: 3\ny_mm: 1\nz_mm: 1\n")
    found = files.read_acquisition(spark, str(tmp_path))
    assert "text" not in plan(found).lower().replace("context", "")
    assert sorted((r.gx, r.gy, r.gz) for r in found.collect()) == [(1, 1, 1), (2, 1, 1)]


def test_features_of_links_take_their_voxels_once(spark):
    assert "l_orderkey" not in plan(QUERIES["f22_classifier_link_features"](spark, TABLES))


def test_fitting_reads_split_rows(spark, monkeypatch):
    seen, train = [], learning.train
    monkeypatch.setattr(learning, "train", lambda rows, *a, **k: seen.append(plan(rows)) or train(rows, *a, **k))
    assert QUERIES["l3_l4_train_and_score"](spark, TABLES).count() > 0
    assert seen and "Window" not in seen[0] and "Join" not in seen[0]


def painted(voxels):
    """Every cell of every ball, one after another."""
    classes, best = [1, 2**0.5, 2, 5**0.5, 3], {}
    for x, y, z, r, label in voxels:
        rank = next((i for i in range(4) if r < (classes[i] + classes[i + 1]) / 2), max(int(r + 0.5), 3) + 1)
        half, square = (rank - 1, (rank - 1) ** 2) if rank > 3 else ((0, 0), (1, 1), (1, 3), (2, 4))[rank]
        for d in np.ndindex(*[2 * half + 1] * 3):
            i, j, k = (c - half for c in d)
            if i * i + j * j + k * k <= square:
                at = x + i, y + j, z + k
                best[at] = max(best.get(at, (-1, 0)), (rank, label))
    return {at: label for at, (_, label) in best.items()}


def test_balls_cross_tiles_and_are_no_rows(spark):
    """Negative places, sides of tiles, copies of a place: as cell by cell; no ball is spread into rows."""
    draw = random.Random(8)
    voxels = [(*(draw.randrange(-6, 54) for _ in range(3)), draw.choice([0.5, 1.3, 1.9, 2.4, 3.0, 5.0]), draw.randrange(-50, 50)) for _ in range(150)]
    voxels += [(*v[:4], v[4] + 7) for v in voxels[:20]]
    df = grids.balls(spark.createDataFrame(voxels, "x int, y int, z int, r double, label int"), "r", "label")
    assert {(r.x, r.y, r.z): r.label for r in df.collect()} == painted(voxels)
    assert "Aggregate" not in plan(df)


@pytest.mark.parametrize("wide", [0, 20])
def test_wide_balls_in_a_tile(monkeypatch, wide):
    monkeypatch.setattr(grids, "WIDE", wide)
    draw = np.random.default_rng(2)
    place, rank, label = draw.integers(-4, 52, (60, 3)), draw.integers(4, 8, 60), draw.permutation(60)
    at, found = grids._painted(place, rank, label)
    want = painted([(*p, k - 1.0, v) for p, k, v in zip(place.tolist(), rank.tolist(), label.tolist(), strict=True)])
    got = {p: v for *p, v in ()} if not len(found) else {tuple(map(int, p)): int(v) for p, v in zip(zip(*at, strict=True), found, strict=True)}
    assert got == {p: v for p, v in want.items() if all(0 <= c < grids.TILE for c in p)}
