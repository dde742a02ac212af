"""Hard negatives against plain code and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm.hard_negatives import Best, hard_negatives, negatives_sql
from netloom.llm.queries import op11_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=10):
    valid = [(i, [int(np.floor(256 * float(c))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    found = []
    for a, x, label in (r for r in valid if is_anchor(r[0])):
        scored = [(-sum(p * q for p, q in zip(x, v, strict=False)), i, y) for i, v, y in valid if i != a]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            window = sorted(r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)[:negatives]
            found += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(window, 1)]
    return sorted(found)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_the_query_against_sql(spark):
    embeddings = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{embeddings}'")
    want = con.sql(negatives_sql())
    assert want.columns == COLUMNS
    got = result(op11_hard_negatives(spark, "/root/testdata/sf0.001"))
    assert got == sorted(want.fetchall()) and len(got) > 50


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_small_table(spark, block_bytes):
    r = np.random.default_rng(3)
    rows = [(i, np.round(r.normal(size=6) / 2 + 0.4, 1).tolist(), int(r.integers(4))) for i in range(150)]  # many ties
    rows += [(200 + i, rows[7][1], rows[7][2] if i % 2 else 3 - rows[7][2]) for i in range(60)]  # a third are copies
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 6, 1), (303, [float("nan")] * 6, 1), (310, [float("inf")] * 6, 1), (304, [0.0] * 6, None), (None, rows[0][1], 1), (305, rows[0][1][:4], 1), (306, [1e4] * 6, 2), (320, [-1.0] * 6, 2), (330, [0.0] * 6, 1)]
    df = spark.createDataFrame([(*x, "old") for x in rows], "vec_id long, embedding array<double>, label int, rank string").repartition(5)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert got.columns == COLUMNS
    assert result(got) == brute(rows, lambda i: i % 10 == 0)


def test_huge_components(spark):
    rows = [(0, [3e12, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.0], 1), (3, [1.0, -5e11], 1), (10, [1e15, 1e15], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = result(hard_negatives(df, F.col("vec_id") == 0))
    assert [g for g in got if g[1] == 1] == [g for g in brute(rows, lambda i: i == 0) if g[1] == 1] != []


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.1], 1), (2, [0.5, 0.1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one = [(0, 1, k, 2, 65536, 32768) for k in (1, 2)]
    assert result(hard_negatives(df, F.col("vec_id") == 0)) == sorted(one * 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(hard_negatives(df, F.col("vec_id") == 0)) == []


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 5, 5, -9]), np.array([9, 3, 4, 1]))
    best.add(np.array([0, 0]), np.array([5, 4]), np.array([1, 0]))
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 5, 1), (0, 5, 3), (1, -9, 1)]
