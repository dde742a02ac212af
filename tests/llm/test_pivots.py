"""The pivot index against all cosines."""

from pathlib import Path

import numpy as np
import pyarrow.dataset as ds
import pytest

from netloom.llm.pivots import near_vectors


def brute(ids, vectors, threshold=0.95):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if k else None for v, k in zip(vectors, ok, strict=True)]
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    least = list(ids)
    for start in range(n):
        seen, open_ = {start}, [start]
        while open_:
            for j in near[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        least[start] = ids[start] if not ok[start] else min((ids[j] for j in seen if ids[j] is not None), default=None)
    return [(ids[i], len(near[i]), least[i], not ok[i] or (ids[i] is not None and ids[i] == least[i])) for i in range(n)]


@pytest.mark.parametrize("tile", [1000, 5])
def test_small_table(spark, tile):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 32))
    vectors = [(centres[r.integers(12)] * r.uniform(0.5, 2) + 0.02 * r.normal(size=32)).astype(np.float32).tolist() for _ in range(90)]
    vectors += [r.normal(size=32).astype(np.float32).tolist() for _ in range(40)]
    vectors += [vectors[0]] * 3 + [None, [], [0.0] * 32, [float("nan")] * 32, [None, *vectors[3][1:]], [float("inf"), *vectors[3][1:]], vectors[5][:16], vectors[5][:16], vectors[7]]
    ids = [*range(1000, 1000 - len(vectors) + 2, -1), 999, None]
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids), strict=True)), "vec_id long, embedding array<float>, n string")
    out = near_vectors(df, tile=tile, carry=["vec_id", "n"])
    assert out.columns == ["vec_id", "n", "n_links", "component_id", "kept"]
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in out.collect()), key=str)
    assert got == sorted(brute(ids, vectors), key=str)


def test_recall_on_the_embeddings(spark):
    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test data")
    table = ds.dataset(path).to_table()
    x = np.stack(table.column("embedding").to_pylist()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_vectors(spark.read.parquet(str(path)), carry=["vec_id"]).collect()}
    found = np.array([got[i] for i in table.column("vec_id").to_pylist()])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()


@pytest.mark.parametrize("low", [0.95, 0.96, 0.97, 0.98, 0.99])
def test_recall_on_planted_pairs(spark, low):
    r = np.random.default_rng(7)
    n, dim = 1500, 64
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in r.normal(size=(2, n, dim)))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = r.uniform(low + 1e-6, low + 0.01, n)[:, None]
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])
    links = int((both @ both.T >= 0.95).sum() - 2 * n)
    assert links >= 2 * n
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    assert links >= sum(v.n_links for v in near_vectors(df, carry=["vec_id"]).collect()) > 0.92 * links


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
