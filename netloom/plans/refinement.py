"""Queries: clean-up of graphs to the end (R5, R9, R11, R13), overlapping runs (G21), branch pairs (G25), end tangents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chains, cleaning, deletion, graph, learning, moments, spatial
from ..sources.scratch import checkpointed
from .chains import chain_sql, linked
from .coordinates import r6
from .registry import Tables, query

#: Voxels up to which a hair, a self-loop and a parallel link are removed (fixed values of the queries).
HAIR, LOOP, WEAK = 8, 20, 15


def removable(links: DataFrame, hair: int = HAIR, loop: int = LOOP, weak: int = WEAK) -> DataFrame:
    """``link_label`` and ``kind`` of links to remove: hairs (one free end), short self-loops, weak parallel links.

    Of two parallel links the one of less intensity goes if the shorter one has at most ``weak``
    voxels; of three or more all but the most intense go if all have at most that.
    """
    ends = links.select("link_label", F.explode(F.array("node_a", "node_b")).alias("node"))
    free = ends.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node").groupBy("link_label").agg(F.sum((F.col("degree") == 1).cast("int")).alias("free"))
    hairs = links.join(free, "link_label").where((F.col("free") == 1) & (F.col("n_voxel") <= hair)).select("link_label", F.lit("hair").alias("kind"))
    loops = links.where((F.col("node_a") == F.col("node_b")) & (F.col("n_voxel") <= loop)).select("link_label", F.lit("loop").alias("kind"))
    w = Window.partitionBy("u", "v")
    pairs = graph.ordered_pair(links).where("u < v").select("link_label", F.count("*").over(w).alias("n"), F.min("n_voxel").over(w).alias("least"), F.max("n_voxel").over(w).alias("most"), F.row_number().over(w.orderBy(F.desc("intensity"), "link_label")).alias("i"))
    parallel = pairs.where(((F.col("n") == 2) & (F.col("least") <= weak) & (F.col("i") == 2)) | ((F.col("n") >= 3) & (F.col("most") <= weak) & (F.col("i") > 1))).select("link_label", F.lit("parallel").alias("kind"))
    return hairs.unionByName(loops).unionByName(parallel).groupBy("link_label").agg(F.min("kind").alias("kind"))


def clean_up(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` (link_label, node_a, node_b, length, n_voxel, intensity) without what is removable, again and again, and the audit: round, kind, n.

    After each round chains through nodes of two links become one link. Every round that removes
    something leaves fewer links, so the rounds end; only their counts by kind are the driver's.
    """
    left, audit, step = checkpointed(links), None, 0
    while True:
        step += 1
        gone = checkpointed(removable(left))
        if gone.isEmpty():
            break
        counts = gone.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(step).alias("round"), "kind", "n")
        audit = counts if audit is None else audit.unionByName(counts)
        kept = left.join(gone, "link_label", "left_anti")
        # a ring that contraction closes hangs on no node: it is nobody's neighbour any more
        left = checkpointed(graph.contract(kept, keep=True).drop("n_links").where("node_a IS NOT NULL"))
    return left, audit if audit is not None else gone.select(F.lit(0).alias("round"), "kind", F.lit(0).cast("long").alias("n"))


#: Free ends at the volume's sides are cut off, not loose.
INNER = "x BETWEEN 2 AND 23 AND y BETWEEN 2 AND 23"


@query("r5_fixpoint_clean_up")
def r5(t: Tables) -> DataFrame:
    """How many chains and voxels of each kind each round removes from the voxels."""
    return cleaning.cleaned(t.V, HAIR, LOOP, WEAK, INNER)[1]


#: Size below which a leaf branch is pruned, above which another object's leaf branch protects it, and how near that one is (one value in all three).
LEAF = 5


def leaf_branches(voxels: DataFrame, most: int) -> DataFrame:
    """label and size of branches (chains without nodes' voxels) to prune.

    A branch goes if it has a free end, fewer than ``most`` voxels, and no free end of another
    object within ``most`` of one of its own whose branch has more than ``most`` voxels.
    """
    voxels = chains.neighbour_counts(voxels.select("voxel_id", "x", "y", "z"))
    objects = spatial.touching(voxels, "voxel_id").select(F.col("node").alias("voxel_id"), F.col("component").alias("object"))
    leaves = checkpointed(chains.chains(voxels).join(voxels.where("n = 1"), "voxel_id").join(objects, "voxel_id").select("label", "size", "object", "x", "y", "z"))
    short = leaves.where(F.col("size") < most)
    safe = spatial.within(short, leaves.where(F.col("size") > most), most).where("a.object <> b.object").select("a.label").distinct()
    return short.select("label", "size").distinct().join(safe, "label", "left_anti")


@query("r9_prune_leaf_branches", f"""{chain_sql('V')}, cr(voxel_id, root) AS (SELECT voxel_id, voxel_id FROM cls UNION SELECT adj.v, cr.root FROM cr JOIN adj ON adj.u = cr.voxel_id), comp AS MATERIALIZED (SELECT voxel_id, min(root) AS object FROM cr GROUP BY 1),
leaf AS MATERIALIZED (SELECT label, size, object, x, y, z FROM link JOIN cls USING (voxel_id) JOIN comp USING (voxel_id) WHERE n = 1),
safe AS (SELECT DISTINCT a.label FROM leaf a JOIN leaf b ON a.size < {LEAF} AND b.size > {LEAF} AND b.object <> a.object AND abs(a.x - b.x) <= {LEAF} AND abs(a.y - b.y) <= {LEAF} AND b.z BETWEEN a.z - {LEAF} AND a.z + {LEAF} WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= {LEAF})
SELECT DISTINCT label, size FROM leaf WHERE size < {LEAF} AND label NOT IN (SELECT label FROM safe)""")
def r9(t: Tables) -> DataFrame:
    """Branches to prune."""
    return leaf_branches(t.V, LEAF)


@query("r13_guarded_delete")
def r13(t: Tables) -> DataFrame:
    """What becomes of dim links, the dimmest first: deleted, or left because a node would become an endpoint, because a join changed them before, or because they have no nodes."""
    links = t.L.select("link_label", "node_a", "node_b", (F.floor("length") + 1).alias("size"))
    chosen = t.L.where("intensity <= 120").select("link_label", F.struct("intensity", "link_label").alias("ord"))
    left, report = deletion.guarded_delete(links, chosen)
    now = left.select("link_label", F.col("size").alias("size_left"))
    return report.join(links.select("link_label", "size"), "link_label", "left").join(now, "link_label", "left")


@query("r11_refinement_round")
def r11(t: Tables) -> DataFrame:
    """One round: clean up, score loose links and drop, score dim short links and drop, score gap links and add; the audit of links before and after each step.

    The classifier is trained on links annotated by their intensity; steps are rows of a handful of counts.
    """
    links = t.M.select("link_label", "node_a", "node_b", F.col("length").cast("double").alias("length"), "n_voxel", "intensity")

    def described(rows: DataFrame) -> DataFrame:
        degree = rows.select(F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        end = lambda k: degree.select(F.col("node").alias(f"node_{k}"), F.col("degree").alias(f"degree_{k}"))
        return rows.join(end("a"), "node_a").join(end("b"), "node_b").withColumn("label", (F.col("intensity") < 80).cast("int"))

    features = ["length", "n_voxel", "degree_a", "degree_b"]
    model = learning.train(described(links), features)
    left = clean_up(links)[0]
    steps = [("clean-up", left)]
    for name, chosen in (("loose links", "degree_a = 1 OR degree_b = 1"), ("dim short links", "n_voxel <= 15 AND intensity < 120")):
        scored = learning.score(model, described(left).where(chosen)).where("prediction = 1").select("link_label")
        left = checkpointed(left.join(scored, "link_label", "left_anti"))
        steps.append((name, left))
    gaps = links.join(left, "link_label", "left_anti").where("intensity >= 120")
    added = learning.score(model, described(gaps)).where("prediction = 0").select(*links.columns)
    left = checkpointed(left.unionByName(added))
    steps.append(("gap links", left))
    out = links.agg(F.lit(0).alias("step"), F.lit("begin").alias("name"), F.count("*").alias("links"))
    for i, (name, rows) in enumerate(steps, 1):
        out = out.unionByName(rows.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count("*").alias("links")))
    ends = left.select(F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).where("degree = 1")
    return out.unionByName(ends.agg(F.lit(len(steps) + 1).alias("step"), F.lit("remaining endpoints").alias("name"), F.count("*").alias("links")))


@query("g21_preferred_source", "WITH e AS (SELECT max(block_id) AS last FROM V), d AS (SELECT voxel_id, r, block_id, CASE WHEN block_id <= 2 * last // 3 THEN 2 * last // 3 - block_id END AS d1, CASE WHEN block_id >= last // 3 THEN block_id - last // 3 END AS d2 FROM V, e) SELECT voxel_id, CASE WHEN d2 IS NULL OR d1 >= d2 THEN 1 ELSE 2 END AS run, CASE WHEN d2 IS NULL OR d1 >= d2 THEN r ELSE round(r + 0.1, 6) END AS r FROM d")
def g21(t: Tables) -> DataFrame:
    """Two runs cover the volume from either side: each voxel comes from the run whose block lies deeper inside its own (the first of equal ones)."""
    last = t.V.agg(F.max("block_id").alias("last"))  # one row
    first_run = t.V.crossJoin(F.broadcast(last)).where("block_id <= 2 * last div 3").select("voxel_id", F.lit(1).alias("run"), "r", F.expr("2 * last div 3 - block_id").alias("depth"))
    second_run = t.V.crossJoin(F.broadcast(last)).where("block_id >= last div 3").select("voxel_id", F.lit(2).alias("run"), r6(F.col("r") + 0.1).alias("r"), F.expr("block_id - last div 3").alias("depth"))
    best = first_run.unionByName(second_run).groupBy("voxel_id").agg(F.max(F.struct("depth", -F.col("run"), "r")).alias("m"), F.max_by("r", F.struct("depth", -F.col("run"))).alias("r"), F.max_by("run", F.struct("depth", -F.col("run"))).alias("run"))
    return best.select("voxel_id", "run", "r")


def end_points(t: Tables, most: int = 10) -> DataFrame:
    """Up to ``most`` voxels from either end of each chain of three or more: label, end, x, y, z, pos, and the chain's ``size``."""
    found = linked(t.V).where("pos IS NOT NULL AND size > 2").select("label", "pos", "size", *(F.col(k).cast("double").alias(k) for k in "xyz"))
    first = found.where(F.col("pos") <= most).withColumn("end", F.lit(1))
    last = found.where(F.col("pos") > F.col("size") - most).withColumn("end", F.lit(2))
    return first.unionByName(last)


def axes(points: DataFrame, keys: list[str]) -> DataFrame:
    """n, centre, second moments and first principal axis of each group's points."""
    m = moments.second_moments(points, keys, ["x", "y", "z"])
    centre = points.groupBy(*keys).agg(*(F.avg(k).alias(f"c{k}") for k in "xyz"))
    six = [F.col(k) for k in moments.SIX]
    # written in between: the axis names each eigenvalue many times, and one plan would spell them out each time
    solved = checkpointed(m.join(centre, keys).withColumns({f"e{i}": v for i, v in enumerate(moments.eigenvalues(six))}))
    products = checkpointed(solved.withColumns({f"k{i}": v for i, v in enumerate(moments.axis_columns(six, [F.col(f"e{i}") for i in range(3)]))}))
    return products.select(*keys, "n", "cx", "cy", "cz", *moments.SIX, *(v.alias(f"u{k}") for k, v in zip("xyz", moments.longest_column([F.col(f"k{i}") for i in range(9)]), strict=True)))


@query("f5_end_tangents")
def f5(t: Tables) -> DataFrame:
    """First principal axis of the first and the last ten voxels of each link, pointing outward along the chord."""
    points = end_points(t)
    found = axes(points, ["label", "end"])
    at = lambda c, p: [F.max(F.when(c, F.col(k))).alias(f"{p}{k}") for k in "xyz"]
    chord = points.groupBy("label").agg(*at(F.col("pos") == 1, "a"), *at(F.col("pos") == F.col("size"), "b"))
    along = sum((F.col(f"u{k}") * (F.col(f"b{k}") - F.col(f"a{k}")) for k in "xyz"), F.lit(0.0))
    outward = F.when((along > 0) == (F.col("end") == 2), 1.0).otherwise(-1.0)
    return found.join(chord, "label").select("label", "end", "n", *(r6(outward * F.col(f"u{k}")).alias(f"t{k}") for k in "xyz"))


@query("g25_branch_pair_alignment")
def g25(t: Tables) -> DataFrame:
    """Ends of different links at most 6 apart: gap, angle of their axes (degrees), rms distance of both point sets to their common axis, covariance divergence."""
    points = checkpointed(end_points(t))
    found = checkpointed(axes(points, ["label", "end"]))
    tips = points.where(((F.col("end") == 1) & (F.col("pos") == 1)) | ((F.col("end") == 2) & (F.col("pos") == F.col("size")))).select("label", "end", "x", "y", "z")
    near = spatial.within(tips, tips, 6).where("a.label < b.label").select(*(F.col(f"{s}.{k}").alias(f"{k}_{s}") for s in "ab" for k in ("label", "end")), F.col("distance").alias("gap"))
    side = lambda s: found.select(*(F.col(c).alias(f"{c}_{s}") for c in found.columns))
    pairs = checkpointed(near.join(side("a"), ["label_a", "end_a"]).join(side("b"), ["label_b", "end_b"]))
    keys = ["label_a", "end_a", "label_b", "end_b"]
    cosine = F.abs(sum((F.col(f"u{k}_a") * F.col(f"u{k}_b") for k in "xyz"), F.lit(0.0)))
    both = pairs.select(*keys, F.explode(F.array(*(F.struct(F.col(f"label_{s}").alias("label"), F.col(f"end_{s}").alias("end")) for s in "ab"))).alias("p")).select(*keys, "p.label", "p.end").join(points, ["label", "end"])
    common = axes(both, keys)
    # around the common axis: total spread less the spread along it
    along = sum((w * F.col(m) * F.col(f"u{m[0]}") * F.col(f"u{m[1]}") for m, w in (("xx", 1), ("xy", 2), ("xz", 2), ("yy", 1), ("yz", 2), ("zz", 1))), F.lit(0.0))
    rms = common.select(*keys, F.sqrt(F.greatest(F.col("xx") + F.col("yy") + F.col("zz") - along, F.lit(0.0))).alias("rms"))
    divergence = F.sqrt(sum((w * F.pow(F.col(f"{m}_a") - F.col(f"{m}_b"), F.lit(2.0)) for m, w in (("xx", 1), ("xy", 2), ("xz", 2), ("yy", 1), ("yz", 2), ("zz", 1))), F.lit(0.0)))
    return pairs.join(rms, keys).select(*keys, r6(F.col("gap")).alias("gap"), F.round(F.degrees(F.acos(F.least(cosine, F.lit(1.0)))), 4).alias("angle"), r6(F.col("rms")).alias("rms"), r6(divergence).alias("divergence"))
