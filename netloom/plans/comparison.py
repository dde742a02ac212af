"""Queries: null models, resampling and removal curves (X6-X10), owner groups and reports (Q4, Q13, Q17), cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curves, forest, graph, learning, spatial, stats
from ..sources.scratch import checkpointed
from .coordinates import r6
from .registry import Tables, query
from .statistics import bin_sql

SEED = 7


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts), F.lit(str(SEED)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def uniform_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || '.join(chr(39) + '|' + chr(39) + ' || ' + p if i else p for i, p in enumerate(f'({x})::VARCHAR' for x in parts))} || '|{SEED}'), 1, 8) AS BIGINT) / 4294967296.0"


DRAWS = 12
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
ANISOTROPY = "sqrt(1.5 * greatest(1 - pow(xx + yy + zz, 2) / 3 / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 0))"


def direction_anisotropy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fractional anisotropy of each group's unit directions x, y, z, weighted by w."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in PAIRS), F.count("*").alias("n"))
    return sums.where("n >= 3").select(*keys, F.expr(ANISOTROPY).alias("fa"))


@query("x6_null_model_scores", f"""WITH u AS MATERIALIZED (SELECT link_label, block_id, length::DOUBLE AS w, vx / g AS x, vy / g AS y, vz / g AS z FROM (SELECT *, sqrt(pow(vx, 2) + pow(vy, 2) + pow(vz, 2)) AS g FROM C) c WHERE g > 0),
o AS (SELECT block_id, {ANISOTROPY} AS fa FROM (SELECT block_id, count(*) AS n, {', '.join(f'sum(w * {a} * {b}) AS {a}{b}' for a, b in PAIRS)} FROM u GROUP BY 1) s WHERE n >= 3),
h AS (SELECT block_id, w, draw, 2 * {uniform_sql('link_label', 'draw', "'z'")} - 1 AS z, 6.283185307179586 * {uniform_sql('link_label', 'draw', "'a'")} AS a FROM u, (SELECT range AS draw FROM range({DRAWS})) d),
m AS (SELECT block_id, draw, {ANISOTROPY} AS fa FROM (SELECT block_id, draw, count(*) AS n, {', '.join(f'sum(w * {a} * {b}) AS {a}{b}' for a, b in PAIRS)} FROM (SELECT block_id, draw, w, sqrt(1 - z * z) * cos(a) AS x, sqrt(1 - z * z) * sin(a) AS y, z FROM h) q GROUP BY 1, 2) s WHERE n >= 3)
SELECT o.block_id, round(any_value(o.fa), 6) AS observed, round(avg(m.fa), 6) AS mean, round(stddev_samp(m.fa), 6) AS std, round((any_value(o.fa) - avg(m.fa)) / nullif(stddev_samp(m.fa), 0), 4) AS z, round(avg(CASE WHEN m.fa >= o.fa THEN 1 ELSE 0 END), 6) AS p FROM o JOIN m USING (block_id) GROUP BY o.block_id""")
def x6(t: Tables) -> DataFrame:
    """Anisotropy of each block's directions against random directions with the same weights: z score, and the share of draws at least as anisotropic."""
    g = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    unit = t.C.withColumn("g", g).where("g > 0").select("link_label", "block_id", F.col("length").cast("double").alias("w"), *((F.col(f"v{k}") / F.col("g")).alias(k) for k in "xyz"))
    observed = direction_anisotropy(unit, ["block_id"])
    drawn = unit.select("link_label", "block_id", "w", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    drawn = drawn.withColumn("z", 2 * uniform("link_label", "draw", F.lit("z")) - 1).withColumn("a", 6.283185307179586 * uniform("link_label", "draw", F.lit("a")))
    flat = F.sqrt(1 - F.col("z") * F.col("z"))
    null = direction_anisotropy(drawn.select("block_id", "draw", "w", (flat * F.cos("a")).alias("x"), (flat * F.sin("a")).alias("y"), "z"), ["block_id", "draw"])
    both = observed.join(null.select("block_id", F.col("fa").alias("null")), "block_id")
    out = both.groupBy("block_id").agg(F.first("fa").alias("o"), F.avg("null").alias("m"), F.stddev_samp("null").alias("s"), F.avg((F.col("null") >= F.col("fa")).cast("int")).alias("p"))
    return out.select("block_id", r6(F.col("o")).alias("observed"), r6(F.col("m")).alias("mean"), r6(F.col("s")).alias("std"), F.round((F.col("o") - F.col("m")) / F.when(F.col("s") != 0, F.col("s")), 4).alias("z"), r6(F.col("p")).alias("p"))


TRIPLES = f"""e AS (SELECT node_a AS node, link_label, length::DOUBLE AS length FROM L UNION ALL SELECT node_b, link_label, length::DOUBLE FROM L), t AS (SELECT list(length ORDER BY length) AS v FROM e GROUP BY node HAVING count(*) = 3),
r AS (SELECT row_number() OVER (ORDER BY link_label) AS i, length::DOUBLE AS length FROM L), n AS (SELECT count(*) AS n FROM L), d AS (SELECT draw, k, 1 + CAST(floor({uniform_sql('draw', 'k')} * n) AS BIGINT) AS i FROM range((SELECT count(*) FROM t)) a(draw), range(3) b(k), n),
p AS (SELECT list(length ORDER BY length) AS v FROM d JOIN r USING (i) GROUP BY draw), u AS (SELECT 'data' AS kind, v FROM t UNION ALL SELECT 'resampled', v FROM p), x AS (SELECT kind, unnest(['least', 'median', 'most']) AS part, unnest(v) AS length FROM u)"""


@query("x7_resampled_triples", f"""WITH {TRIPLES}, s AS (SELECT kind, part, count(*) AS n, avg(length) AS mean, stddev_pop(length) AS std FROM x GROUP BY 1, 2),
q AS (SELECT part, length, count(*) FILTER (kind = 'data') AS a, count(*) FILTER (kind <> 'data') AS b FROM x GROUP BY 1, 2), f AS (SELECT part, max(abs(fa - fb)) AS ks FROM (SELECT part, sum(a) OVER w / sum(a) OVER (PARTITION BY part) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY part) AS fb FROM q WINDOW w AS (PARTITION BY part ORDER BY length)) g GROUP BY part),
c AS (SELECT kind, corr(v[1], v[3]) AS c FROM u GROUP BY kind)
SELECT kind, part, n, round(mean, 6) AS mean, round(std, 6) AS std, round(ks, 6) AS ks, round(c, 6) AS least_most_correlation FROM s JOIN f USING (part) JOIN c USING (kind)""")
def x7(t: Tables) -> DataFrame:
    """Least, median and greatest length at nodes of three links, and of as many triples drawn with replacement: moments, their correlation and the KS distance."""
    from .graphs import dense_labels

    ends = graph.both_ways(t.L, "link_label", F.col("length").cast("double").alias("length"))
    given = checkpointed(ends.groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_list("length")).alias("v")).where("size(v) = 3").select("v"))
    rows = dense_labels(t.L.select("link_label", F.col("length").cast("double").alias("length")), "link_label").select(F.col("label").alias("i"), "length")
    n = t.L.agg(F.count("*").alias("n"))  # one row
    draws = given.agg(F.count("*").alias("draws")).where("draws > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).alias("draw")).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    picks = draws.crossJoin(F.broadcast(n)).select("draw", (1 + F.floor(uniform("draw", "k") * F.col("n"))).alias("i"))
    drawn = picks.join(rows, "i").groupBy("draw").agg(F.array_sort(F.collect_list("length")).alias("v")).select("v")
    both = checkpointed(given.withColumn("kind", F.lit("data")).unionByName(drawn.withColumn("kind", F.lit("resampled"))))
    x = both.select("kind", F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.col("v")[i].alias("length")) for i, p in enumerate(("least", "median", "most"))))))
    sums = x.groupBy("kind", "part").agg(F.count("*").alias("n"), r6(F.avg("length")).alias("mean"), r6(F.stddev_pop("length")).alias("std"))
    counts = x.groupBy("part", "length").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("data", "resampled")))
    part = Window.partitionBy("part")
    share = [F.sum(k).over(part.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)) / F.sum(k).over(part) for k in ("data", "resampled")]
    ks = counts.withColumn("d", F.abs(share[0] - share[1])).groupBy("part").agg(r6(F.max("d")).alias("ks"))
    correlation = both.groupBy("kind").agg(r6(F.corr(F.col("v")[0], F.col("v")[2])).alias("least_most_correlation"))
    return sums.join(ks, "part").join(correlation, "kind")


SHARES, REPLICATES = (0.2, 0.4, 0.6, 0.8), 2
#: Composite keys leave this many labels to each share and replicate.
ROOM = 10**12


def removal_sql(settings: str) -> str:
    """sizes (s, root, nodes) of the components of kept links for ``settings`` (s, share, rep)."""
    return f"""k AS (SELECT * FROM {settings}), e AS MATERIALIZED (SELECT s, node_a AS u, node_b AS v FROM L, k WHERE {uniform_sql('link_label', 'rep')} < share), b AS MATERIALIZED (SELECT s, u, v FROM e UNION SELECT s, v, u FROM e),
reach(s, node, root) AS (SELECT s, u, u FROM b UNION SELECT b.s, b.v, reach.root FROM reach JOIN b ON b.s = reach.s AND b.u = reach.node), sizes AS (SELECT s, root, count(*) AS nodes FROM (SELECT s, node, min(root) AS root FROM reach GROUP BY 1, 2) q GROUP BY 1, 2)"""


def settings_sql(shares: tuple[float, ...], reps: int) -> str:
    return "(VALUES " + ", ".join(f"({i * reps + j}, {p}, {j})" for i, p in enumerate(shares) for j in range(reps)) + ") AS v(s, share, rep)"


def entering(t: Tables, shares: tuple[float, ...], reps: int, core: bool = False) -> DataFrame:
    """Links of each replicate with ``step``, the first of the rising shares that keeps them (core: in the 2-core); ends are told apart by replicate."""
    draw = uniform("link_label", "rep")
    step = F.coalesce(*(F.when(draw < F.lit(p), F.lit(i)) for i, p in enumerate(shares)))
    rows = t.L.select("link_label", "node_a", "node_b", F.col("length").cast("double").alias("length"), F.explode(F.array(*map(F.lit, range(reps)))).alias("rep")).withColumn("step", step).where("step IS NOT NULL")
    base = F.col("rep").cast("long") * ROOM
    rows = rows.select((F.col("link_label") + base).alias("link_label"), *((F.col(k) + base).alias(k) for k in ("node_a", "node_b")), "length", "step", "rep")
    return forest.core_steps(rows, len(shares)) if core else rows


def component_steps(links: DataFrame, steps: int) -> DataFrame:
    """rep, step, component, nodes, links and length of each component at each step, from one merge tree."""
    alive, gains = forest.merge_tree(links)
    spans = alive.select("component", "nodes", F.explode(F.sequence("birth", F.coalesce("death", F.lit(steps)) - 1)).alias("step"))
    # steps at which nothing came in stand between others: sums run over both
    rows = spans.select("component", "step", "nodes", F.lit(0).cast("long").alias("links"), F.lit(0.0).alias("length")).unionByName(gains.select("component", "step", F.lit(None).cast("long").alias("nodes"), "links", "length"))
    sums = rows.groupBy("component", "step").agg(F.max("nodes").alias("nodes"), F.sum("links").alias("links"), F.sum("length").alias("length"))
    run = Window.partitionBy("component").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row a step
    whole = sums.select("component", "step", "nodes", *(F.sum(k).over(run).alias(k) for k in ("links", "length"))).where("nodes IS NOT NULL")
    return whole.withColumn("rep", F.floor(F.col("component.node") / ROOM).cast("int"))


#: Components whose sizes are recorded, and parts of a step that are ranked for themselves first.
TOP, PARTS = 10, 64


def largest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The ``TOP`` rows of each group by ``value``, ranked in parts first, so that no task takes a whole group."""
    order = [F.desc(value), "component"]
    some = rows.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(PARTS)))
    best = some.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))).where(F.col("i") <= TOP)
    return best.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("i") <= TOP).drop("part")


@query("x8_edge_removal_curve", f"""WITH RECURSIVE {removal_sql(settings_sql(SHARES, REPLICATES))}, o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY nodes DESC, root) AS i, sum(nodes) OVER (PARTITION BY s) AS total FROM sizes),
g AS (SELECT share, s, count(*)::DOUBLE AS components, max(nodes)::DOUBLE AS largest, sum(nodes) FILTER (i <= 10) / any_value(total)::DOUBLE AS top FROM o JOIN k USING (s) GROUP BY 1, 2)
SELECT share, count(*) AS replicates, round(avg(components), 6) AS components, round(stddev_samp(components), 6) AS components_std, round(avg(largest), 6) AS largest, round(stddev_samp(largest), 6) AS largest_std, round(avg(top), 6) AS top_share, round(stddev_samp(top), 6) AS top_share_std FROM g GROUP BY share""")
def x8(t: Tables) -> DataFrame:
    """For each kept share of links: number of components, largest one and share of the ten largest, mean and sample deviation over replicates."""
    rows = checkpointed(component_steps(entering(t, SHARES, REPLICATES), len(SHARES)))
    sums = rows.groupBy("step", "rep").agg(F.count("*").alias("components"), F.max("nodes").alias("largest"), F.sum("nodes").alias("total"))
    top = largest(rows, ["step", "rep"], "nodes").groupBy("step", "rep").agg(F.sum("nodes").alias("top"))
    each = sums.join(top, ["step", "rep"]).withColumn("top_share", F.col("top") / F.col("total"))
    stat = [(f, n) for k in ("components", "largest", "top_share") for f, n in ((F.avg(k), k), (F.stddev_samp(k), f"{k}_std"))]
    return each.groupBy(share_of(SHARES)).agg(F.count("*").alias("replicates"), *(r6(f).alias(n) for f, n in stat))


def share_of(shares: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, shares)), F.col("step") + 1).alias("share")


STEPS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)


@query("x9_sequential_removal", f"""WITH RECURSIVE k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(STEPS))}) AS v(s, share)), lk AS MATERIALIZED (SELECT s, link_label, node_a, node_b, length::DOUBLE AS length FROM L, k WHERE {uniform_sql('link_label', '0')} < share),
gone(s, link_label) USING KEY (s, link_label) AS (SELECT -1, -1::BIGINT UNION (WITH left_ AS (SELECT lk.* FROM lk WHERE NOT EXISTS (SELECT 1 FROM recurring.gone g WHERE g.s = lk.s AND g.link_label = lk.link_label)),
 e AS (SELECT s, link_label, node_a AS node FROM left_ UNION ALL SELECT s, link_label, node_b FROM left_) SELECT DISTINCT s, min(link_label) FROM e WHERE (SELECT count(*) FROM gone) > 0 GROUP BY s, node HAVING count(*) = 1)),
core AS MATERIALIZED (SELECT lk.* FROM lk WHERE (s, link_label) NOT IN (SELECT (s, link_label) FROM gone)),
b AS MATERIALIZED (SELECT s, node_a AS u, node_b AS v FROM core UNION SELECT s, node_b, node_a FROM core), reach(s, node, root) AS (SELECT s, u, u FROM b UNION SELECT b.s, b.v, reach.root FROM reach JOIN b ON b.s = reach.s AND b.u = reach.node), cc AS (SELECT s AS cs, node, min(root) AS root FROM reach GROUP BY 1, 2),
z AS (SELECT s, root, count(*) AS links, sum(length) AS length FROM core JOIN cc ON cs = s AND node = node_a GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY links DESC, root) AS i FROM z)
SELECT share, count(*) AS components, sum(links)::BIGINT AS links, round(sum(length), 5) AS length, max(links) AS largest, round(max(links) / sum(links), 6) AS largest_share, sum(links) FILTER (i <= {TOP})::BIGINT AS top_links, round(max(length) / sum(length), 6) AS longest_share FROM o JOIN k USING (s) GROUP BY share""")
def x9(t: Tables) -> DataFrame:
    """Links removed step by step in hashed order, loose ends pruned before each step is recorded: links and length that are left, components, the largest ones by links and the longest one.

    What pruning leaves doesn't depend on when it was done, so a link has one first step at which it
    is in the pruned graph, and one merge tree over these answers all steps.
    """
    rows = checkpointed(component_steps(entering(t, STEPS, 1, core=True), len(STEPS)))
    sums = rows.groupBy("step").agg(F.count("*").alias("components"), F.sum("links").alias("links"), F.sum("length").alias("length"), F.max("links").alias("largest"), F.max("length").alias("longest"))
    top = largest(rows, ["step"], "links").groupBy("step").agg(F.sum("links").alias("top_links"))
    out = sums.join(top, "step")
    return out.select(share_of(STEPS), "components", "links", F.round("length", 5).alias("length"), "largest", r6(F.col("largest") / F.col("links")).alias("largest_share"), "top_links", r6(F.col("longest") / F.col("length")).alias("longest_share"))


FINE = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query("x10_transition_fit", f"""WITH RECURSIVE {removal_sql(settings_sql(FINE, 1))}, c AS (SELECT share::DOUBLE AS p, max(nodes)::DOUBLE / sum(nodes)::DOUBLE AS y FROM sizes JOIN k USING (s) GROUP BY share),
d AS (SELECT p, y, (lead(y) OVER w - lag(y) OVER w) / (lead(p) OVER w - lag(p) OVER w) AS slope, lead(p) OVER w AS p1, lead(y) OVER w AS y1 FROM c WINDOW w AS (ORDER BY p)),
t AS (SELECT (SELECT p FROM d WHERE slope IS NOT NULL ORDER BY slope DESC, p LIMIT 1) AS steepest, (SELECT min(p + (0.5 - y) * (p1 - p) / (y1 - y)) FROM d WHERE y < 0.5 AND y1 >= 0.5) AS half)
SELECT round(steepest, 6) AS steepest, round(half, 6) AS half, count(*) AS points, round(regr_slope(log10(y), p - steepest), 4) AS slope, round(regr_intercept(log10(y), p - steepest), 4) AS intercept FROM c, t WHERE y BETWEEN 0.05 AND 0.95 GROUP BY steepest, half""")
def x10(t: Tables) -> DataFrame:
    """Where the largest component's share rises most steeply and where it passes one half; and the line of its logarithm against the distance from there."""
    rows = component_steps(entering(t, FINE, 1), len(FINE)).withColumn("share", share_of(FINE))
    c = checkpointed(rows.groupBy(F.col("share").cast("double").alias("p")).agg((F.max("nodes") / F.sum("nodes")).alias("y")))
    w = Window.partitionBy(F.lit(0)).orderBy("p")  # one row a share
    d = c.select("p", "y", ((F.lead("y").over(w) - F.lag("y").over(w)) / (F.lead("p").over(w) - F.lag("p").over(w))).alias("slope"), F.lead("p").over(w).alias("p1"), F.lead("y").over(w).alias("y1"))
    half = F.min(F.when((F.col("y") < 0.5) & (F.col("y1") >= 0.5), F.col("p") + (0.5 - F.col("y")) * (F.col("p1") - F.col("p")) / (F.col("y1") - F.col("y"))))
    at = d.agg(F.max(F.when(F.col("slope").isNotNull(), F.struct("slope", (-F.col("p")).alias("p"))))["p"].alias("p"), half.alias("half")).select((-F.col("p")).alias("steepest"), "half")
    rows = c.where("y BETWEEN 0.05 AND 0.95").crossJoin(F.broadcast(at))  # one row
    y, x = F.log10("y"), F.col("p") - F.col("steepest")
    out = rows.groupBy("steepest", "half").agg(F.count("*").alias("points"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))
    return out.select(r6(F.col("steepest")).alias("steepest"), r6(F.col("half")).alias("half"), "points", "slope", "intercept")


@query("q4_owner_groups", "WITH g AS (SELECT * FROM (VALUES (0, 1, 3), (1, 2, 4), (2, 3, 5)) v(grp, low, high)), m AS (SELECT tile, gx, gy, gz, grp FROM T JOIN g ON gx BETWEEN low AND high), s AS (SELECT a.tile, a.grp, count(*) AS score FROM m a JOIN m b ON a.grp = b.grp AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND abs(a.gz - b.gz) <= 1 GROUP BY 1, 2) SELECT tile, grp, score FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, grp) AS i FROM s) o WHERE i = 1")
def q4(t: Tables) -> DataFrame:
    """Groups of blocks overlap: each block belongs to the one where its 27-neighbourhood is most inside (each neighbour counts one at most; the first of equal groups)."""
    groups = F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(a).alias("low"), F.lit(b).alias("high")) for g, a, b in ((0, 1, 3), (1, 2, 4), (2, 3, 5))))
    m = t.T.select("tile", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"), F.explode(groups).alias("g")).where("x BETWEEN g.low AND g.high").select("tile", "x", "y", "z", "g.grp")
    other = m.select("grp", *(F.col(k).alias(f"n{k}") for k in "xyz"))
    scores = spatial.shifted(m, [*spatial.ALL, (0, 0, 0)]).join(other, ["grp", "nx", "ny", "nz"]).groupBy("tile", "grp").agg(F.count("*").alias("score"))
    best = scores.groupBy("tile").agg(F.max(F.struct("score", (-F.col("grp")).alias("g"))).alias("m"))
    return best.select("tile", (-F.col("m.g")).alias("grp"), "m.score")


DEPTH = "p AS (SELECT l_returnflag AS sample, l_linenumber % 2 AS side, l_quantity AS x, avg(l_discount) AS y FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT sample, side, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY sample, side ORDER BY x)), grid AS (SELECT range AS i, 1.5 + range * 2.5 AS x FROM range(19)), s AS (SELECT sample, side, i, grid.x, min(y0 + (y1 - y0) * (grid.x - x0) / (x1 - x0)) AS y FROM grid JOIN g ON grid.x BETWEEN x0 AND x1 GROUP BY 1, 2, 3, 4)"


@query("q13_depth_curve", f"WITH {DEPTH} SELECT i, x, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std FROM s GROUP BY i, x")
def q13(t: Tables) -> DataFrame:
    """Curves of a measure by depth, one for each sample and side, on one grid: mean and deviation over them."""
    points = t.lineitem.groupBy(F.col("l_returnflag").alias("sample"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_quantity").alias("x")).agg(F.avg("l_discount").alias("y"))
    out = curves.mean_curve(curves.resample(points, ["sample", "side"], "x", "y", 1.5, 2.5, 19))
    return out.select("i", "x", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


SEGMENT_BINS = [0.0, 10.0, 20.0, 40.0, 60.0, 80.0, 120.0]


@query("q17_segment_report", f"""WITH seg AS (SELECT class, link_label, length::DOUBLE AS length, r, abs(vx) AS vx, {bin_sql('length', SEGMENT_BINS)} AS bin FROM C), f AS (SELECT class, bin, feature, value, length FROM (SELECT class, bin, length, unnest(['r', 'vx']) AS feature, unnest([r, vx]) AS value FROM seg) u WHERE bin IS NOT NULL),
s AS (SELECT class, feature, bin, count(*) AS n, avg(value) AS mean, median(value) AS median FROM f GROUP BY 1, 2, 3), k AS (SELECT class, bin, sum(length) AS length FROM seg WHERE bin IS NOT NULL GROUP BY 1, 2), cum AS (SELECT class, bin, sum(length) OVER (PARTITION BY class ORDER BY bin) / sum(length) OVER (PARTITION BY class) AS share FROM k),
m AS (SELECT class, 2 * median(r) / avg(vx) AS termination FROM seg GROUP BY class), o AS (SELECT class, min(bin) AS first FROM s WHERE feature = 'r' AND median >= 2.5 GROUP BY class)
SELECT s.class, feature, bin, n, round(mean, 6) AS mean, round(median, 6) AS median, round(share, 6) AS cumulative_length, round(termination, 6) AS termination_length, o.first AS first_bin FROM s JOIN cum USING (class, bin) JOIN m ON m.class = s.class LEFT JOIN o ON o.class = s.class""")
def q17(t: Tables) -> DataFrame:
    """For each class: features by length, cumulative length, estimated termination length, and the first length bin whose median reaches a level."""
    c = t.C.select("class", F.col("length").cast("double").alias("length"), "r", F.abs("vx").alias("vx"), stats.bin_of(F.col("length"), SEGMENT_BINS).alias("bin"))
    binned = c.where("bin IS NOT NULL")
    long = binned.select("class", "bin", F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in ("r", "vx")))))
    s = checkpointed(long.groupBy("class", "feature", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median")))
    whole = Window.partitionBy("class")  # one row a bin
    sums = binned.groupBy("class", "bin").agg(F.sum("length").alias("length"))
    cumulative = sums.select("class", "bin", r6(F.sum("length").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("length").over(whole)).alias("cumulative_length"))
    one = c.groupBy("class").agg(r6(2 * F.median("r") / F.avg("vx")).alias("termination_length"))
    first = s.where("feature = 'r' AND median >= 2.5").groupBy("class").agg(F.min("bin").alias("first_bin"))
    out = s.join(cumulative, ["class", "bin"]).join(one, "class").join(first, "class", "left")
    return out.select("class", "feature", "bin", "n", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), "cumulative_length", "termination_length", "first_bin")


@query("l6_cross_validation")
def l6(t: Tables) -> DataFrame:
    """Cross-validated loss of forests by number of trees and depth, with hashed folds."""
    rows = learning.folds(t.C.withColumn("label", (F.col("r") * F.col("length") > 60).cast("int")), "link_label", 3, SEED)
    return learning.cross_validated(rows.select("label", "length", "r", "vx", "vy", F.col("fold").cast("int").alias("fold")), ["length", "r", "vx", "vy"], trees=(3, 10), depths=(2, 4), k=3)
