"""Cases of the third round's findings."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import spatial


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_spread_side_is_not_broadcast(spark):
    points = spark.range(50).select("id", *(F.col("id").alias(k) for k in "xyz"))
    assert broadcasts(spatial.within(points, points, 2)) == 0
    near = {(r.a, r.b) for r in spatial.within(points, points, 2).select("a.id", "b.id").toDF("a", "b").collect()}
    assert near == {(i, j) for i in range(50) for j in range(50) if abs(i - j) <= 1}


@pytest.mark.parametrize("few", [0, 3_000])
def test_bounded_search_agrees_with_all_pairs(spark, monkeypatch, few):
    """Clusters, gaps and ties: rings end at the bound, and the least key of equally near ones counts."""
    monkeypatch.setattr(spatial, "FEW_POINTS", few)
    at = lambda n, seed: [(i, (i * i * seed) % 97, (i * 31 * seed) % 89, (i * 17) % 7) for i in range(n)]
    one, two = at(60, 3), at(80, 5)
    far = lambda p, q: sum((u - v) ** 2 for u, v in zip(p[1:], q[1:], strict=True)) ** 0.5
    best = lambda ps, qs: {p[0]: min((far(p, q), q[0]) for q in qs if far(p, q) <= 40) for p in ps if any(far(p, q) <= 40 for q in qs)}
    ab, ba = best(one, two), best(two, one)
    df = lambda rows: spark.createDataFrame(rows, "node long, x long, y long, z long")
    got = {r.a: (r.distance, r.b) for r in spatial.nearest_within(df(one), df(two), "node", 40).collect()}
    assert got == ab and len(ab) < len(one) + 1
    pairs = {(r.a, r.b) for r in spatial.mutual_nearest(df(one), df(two), "node", 40).collect()}
    assert pairs == {(a, b) for a, (_, b) in ab.items() if ba[b][1] == a}


def test_bounded_search_does_not_go_through_the_ball(spark):
    """Two thousand points within the bound: each is compared with a few, not with all."""
    points = spark.range(2000).select("id", (F.col("id") % 13).alias("x"), (F.col("id") * 7 % 11).alias("y"), F.floor(F.col("id") / 14).alias("z"))
    looked = []
    plain = spatial.within
    try:
        spatial.within = lambda left, right, radius, *a, **k: looked.append(radius) or plain(left, right, radius, *a, **k)
        assert spatial.nearest_within(points, points, "id", 120).where("distance > 0").count() == 0
    finally:
        spatial.within = plain
    assert max(looked) < 10


def test_second_label_behind_several_cells_of_the_first(spark):
    """A label that fills several cells is still one label: the bound for the second one lies behind it."""
    random = __import__("random").Random(5)
    points = [tuple(random.randrange(400) for _ in range(3)) for _ in range(60)]
    sources = [(random.randrange(400), random.randrange(400), random.randrange(400), 1 + i % 4 // 3 + i % 7 // 6) for i in range(60)]
    df = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    found = spatial.k_nearest(df(points, "x y z"), df(sources, "x y z label"), "label", 2, 2).where("place = 2")
    got = {(r.x, r.y, r.z): (r.distance, r.label) for r in found.collect()}
    far = lambda p, s: sum((u - v) ** 2 for u, v in zip(p, s[:3], strict=True)) ** 0.5
    want = {p: sorted((min(far(p, s) for s in sources if s[3] == k), k) for k in {s[3] for s in sources})[1] for p in points}
    assert got == want


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over made tables."""
    import duckdb

    from netloom.plans import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]}) q").fetchall(), key=str)


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"


def test_axis_of_means_that_cancel_out(spark, tmp_path):
    """Discounts around 0.05 leave 1e-18 for zero: no direction of its own, and no axis at all in block 2."""
    line = lambda i, s, q, d, c: (i, 0, s, 1, q, 1.0, d, 0.0, c)
    rows = [line(1, 1, 25.0, 0.02, "A"), line(2, 1, 25.0, 0.07, "A"), line(3, 1, 25.0, 0.06, "A"), line(4, 1, 40.0, 0.09, "N")]
    rows += [line(5, 2, 25.0, 0.02, "A"), line(6, 2, 25.0, 0.08, "A"), line(7, 2, 30.0, 0.09, "N"), line(8, 3, 30.0, 0.01, "A"), line(9, 3, 30.0, 0.09, "A"), line(10, 3, 35.0, 0.06, "N")]
    got, want = against_sql(spark, tmp_path, "f29_axis_cosine", lineitem=(LINES, rows))
    assert [k for k, v in got if v is None] == [1, 2]
    assert got == want


def test_azimuth_of_a_chord_along_an_axis(spark, tmp_path):
    """A chord that falls and runs along x only points to 180, not to -180."""
    place = lambda k: ((k * 7919) % 1000 + 1, (k * 104729) % 997 + 1)
    a, b = next((i, j) for i in range(40) for j in range(40) if place(j)[0] > place(i)[0] and place(j)[1] < place(i)[1])
    customers = [(k, 1.5) for k in range(40)]  # one y for all
    orders = [(12, a, float(b), "O"), (24, b, float(a), "O")]
    got, want = against_sql(spark, tmp_path, "f2_link_geometry", customer=("c_custkey long, c_acctbal double", customers), orders=("o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string", [(k, u, v + 40.0 * 3, s) for k, u, v, s in orders]))
    assert got == want and {r[3] for r in got} == {180.0}


@pytest.mark.parametrize("keys", [["g"], []])
def test_rank_slice_orders_no_whole_group(spark, keys):
    """Many equal values, a null group, a value that is no number: ranks as by one window, without one."""
    from netloom.operators import stats

    rows = [("a" if i % 3 else None, float(i * 7 % 5), i) for i in range(200)] + [("b", 1.0, 500), ("a", float("nan"), 501), ("c", 2.0, 502), ("c", 2.0, 503)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    out = stats.rank_slice(df, keys, "v", ["id"], 5, 95)
    want = []
    for g in {r[0] for r in rows} if keys else [None]:
        own = sorted((r[1], r[2]) for r in rows if (not keys or r[0] == g) and r[1] == r[1])
        low, high = max(int(len(own) * 5 / 100 + 0.5), 1), int(len(own) * 95 / 100 + 0.5)
        want += [i for _, i in own[low - 1 : high]]
    assert sorted(r.id for r in out.collect()) == sorted(want)
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert windows and all("__v" in line for line in windows)
