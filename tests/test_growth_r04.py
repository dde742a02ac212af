"""What must not grow beyond the input, or not pass the driver."""

import hashlib
import itertools
import math
import random

from pyspark.sql import functions as F

from netloom.operators import forest, gaps, learning, paths, spatial
from netloom.sources.scratch import checkpointed


def plans_of(monkeypatch, module):
    """Physical plans of all that ``module`` writes to scratch from now on."""
    seen, kept = [], module.checkpointed

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(module, "checkpointed", noted)
    return seen


def grid(spark, n, step):
    rows = spark.range(n).select(F.col("id"), (F.col("id") % 20).alias("x"), (F.floor(F.col("id") / 20) % 20).alias("y"), F.floor(F.col("id") / 400).alias("z"))
    return rows.select("id", *((F.col(k) * step).alias(k) for k in "xyz"))


def test_many_points_are_not_broadcast(spark, monkeypatch):
    points, sources = grid(spark, spatial.FEW_POINTS + 1000, 2), grid(spark, 1200, 6).withColumnRenamed("id", "s")
    seen = plans_of(monkeypatch, spatial)
    found = spatial.nearest(points.select("x", "y", "z"), sources, "s", 12)  # one ring finds all; a few that are left may be broadcast
    assert found.count() == points.count()
    assert not any("BroadcastHashJoin" in plan for plan in seen)


def test_places_of_walks_are_not_broadcast(spark):
    voxels = grid(spark, 1200, 3).select(F.col("id").alias("voxel_id"), "x", "y", "z", F.lit(1.0).alias("r"), F.lit(0).alias("link"))
    walk = grid(spark, 3200, 2).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.col("id").alias("k"), "x", "y", "z")
    met = gaps.met(walk, voxels, 3)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == walk.count()


def test_boosted_trees_read_different_rows_once(spark, monkeypatch):
    fitted, pipeline = [], learning.Pipeline
    monkeypatch.setattr(learning, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, rows: fitted.append(rows.count()) or pipeline(stages=stages).fit(rows)})())
    rows = spark.range(20_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), F.lit(None).cast("double").alias("spare"))
    rows = rows.withColumn("label", (F.col("a") > 3).cast("int"))
    model = learning.train(rows, ["a", "b"], kind="boosted")
    assert fitted == [77]
    scored = learning.score(model, rows.unionByName(rows.limit(1).withColumn("a", F.lit(None).cast("double"))))
    assert scored.columns == [*rows.columns, "prediction"] and scored.count() == 20_000
    assert scored.where("prediction <> label").isEmpty()


def test_split_ranks_one_part_of_a_class(spark):
    rows = spark.range(5_000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    for share, balance in ((0.5, False), (0.3, True), (0.0, False), (1.0, False)):
        got = learning.hashed_split(rows, "id", "label", share, 7, balance=balance).where("train").select("id", "label").collect()
        least = 1667 if balance else None
        for label in (0, 1):
            ids = [r.id for r in rows.where(F.col("label") == label).select("id").collect()]
            first = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|7".encode()).hexdigest(), i))[: int(share * (least or len(ids)) + 0.5)]
            assert sorted(r.id for r in got if r.label == label) == sorted(first)
    plan = learning.hashed_split(rows, "id", "label", 0.5, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (__p" in plan  # rows of all other parts pass no window


def test_pairs_are_counted_and_never_rows(spark):
    r = random.Random(4)
    for scale, whole in ((40, True), (9, False), (300, False)):
        rows = [(i if i % 9 else 3, *(float(r.randint(-scale, scale)) if whole else r.uniform(-scale, scale) for _ in range(3))) for i in range(600)]
        rows += [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
        found = spatial.distance_bins(spark.createDataFrame(rows, "node long, x double, y double, z double"), "node", 30, 7)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for a, b in itertools.combinations([x for x in rows if None not in x and x[1] == x[1]], 2):
            d = math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
            if a[0] != b[0] and d <= 30:
                n, far = want.get(math.floor(d / 7), (0, 0.0))
                want[math.floor(d / 7)] = (n + 1, far + abs(a[1] - b[1]))
        got = {x.bin: (x.n, x.far) for x in found.collect()}
        assert got.keys() == want.keys()
        for k, (n, far) in want.items():
            assert got[k][0] == n and math.isclose(got[k][1], far, rel_tol=1e-9)


def test_rest_of_a_forest_in_one_task_and_in_rounds(spark, monkeypatch):
    r = random.Random(5)
    links = [(100 + i, r.randint(0, 60), r.randint(0, 60)) for i in range(70)]
    rows = spark.createDataFrame(links, "link_label long, node_a long, node_b long")
    edges = rows.selectExpr("link_label AS id", "node_a AS u", "node_b AS v")
    found, rounds = [], []
    for few in (forest.FEW, 20, 0):
        monkeypatch.setattr(forest, "FEW", few)
        calls, kept = [], checkpointed
        monkeypatch.setattr(forest, "checkpointed", lambda df, calls=calls: calls.append(1) or kept(df))
        taken = {x.id for x in forest.spanning_forest(edges).collect()}
        tree = edges.where(F.col("id").isin(taken) & (F.col("u") != F.col("v")))
        tour = {(x.tree, x.u, x.v, x.left) for x in forest.tours(tree.select("u", "v")).collect()}
        found.append((taken, tour, {x.link_label for x in forest.bridges(rows).collect()}))
        rounds.append(len(calls))
    assert found[0] == found[1] == found[2] and found[0][2] and found[0][1]
    assert rounds[0] < 15 < rounds[2]
    assert forest.spanning_forest(edges.limit(0)).isEmpty()


def test_radii_of_loops_widen_gently():
    assert paths.WIDER < 2
