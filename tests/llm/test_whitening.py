"""Whitening against plain code in exact fractions."""

from fractions import Fraction

import numpy as np
import pytest

from netloom.llm.queries import op13_whitening
from netloom.llm.whitening import Whitening, whiten

SCHEMA = "vec_id long, embedding array<double>, n string"


def exact(vectors):
    """n, sums and covariance of the distinct vectors, as fractions."""
    fit = sorted({tuple(v) for v in vectors})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    x = np.array(fit, object)
    cov = [[Fraction(int(c), n**3) for c in r] for r in (n * x - sums).T @ (n * x - sums)]
    return n, sums, cov


def check(rows, vectors):
    n, sums, cov = exact(vectors.values())
    v = np.array([[float(c) for c in r] for r in cov])
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    mean = np.array([s / n for s in sums])
    assert len(rows) == 4 * len(vectors)
    by = {}
    for r in rows:
        x = vectors[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
    ids = sorted(vectors)
    centred = np.array([vectors[i] for i in ids]) - mean
    for k in (1, 2, 3, 4):
        w = np.array([by[k][i] for i in ids]) * np.sqrt(values[k - 1])
        component = np.linalg.lstsq(centred, w, rcond=None)[0]
        assert np.linalg.norm(component) == pytest.approx(1, abs=1e-9)
        assert np.abs(v @ component - values[k - 1] * component).max() < 1e-9 * values[0]


def test_the_query(spark):
    path = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    check(op13_whitening(spark, path).collect(), {r["vec_id"]: [int(np.floor(256 * float(c))) for c in r["embedding"]] for r in given})


def test_copies_count_once_and_large_values_are_exact(spark):
    r = np.random.default_rng(1)
    plain = [(r.normal(size=5) * [1, 2, 3, 4, 5] + [1e7, -1e7, 0, 3, 1e5]).tolist() for _ in range(60)]
    rows = [(i, v, "old") for i, v in enumerate(plain + plain[:1] * 40)]
    bad = [(500, None, "a"), (501, [None, 1.0, 1.0, 1.0, 1.0], "a"), (502, [float("nan")] * 5, "a"), (503, [float("-inf")] * 5, "a")]
    out = whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(3), carry=["vec_id", "n"])
    check(out.collect(), {i: [int(np.floor(256 * c)) for c in v] for i, v, _ in rows})
    assert out.columns[:2] == ["vec_id", "component"]  # n is an output


def test_values_at_the_limits_of_a_long(spark):
    rows = [(i, [1e30 * (i % 2), float(i), -1e30 * (i % 3)], "") for i in range(6)]
    out = whiten(spark.createDataFrame(rows, SCHEMA), components=2).collect()
    assert len(out) == 12 and all(r["identity_error"] < 1e-9 for r in out)
    assert all(r["deviation"] is None for r in out)


def test_components_without_variance(spark):
    rows = [(i, [float(i % 3), 1.0, 2.0], "") for i in range(9)]
    out = {(r["vec_id"], r["component"]): r for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 27
    assert out[0, 1]["n"] == 3 and out[0, 1]["explained"] == pytest.approx(1) and abs(out[0, 1]["whitened"]) == pytest.approx(np.sqrt(1.5))
    assert out[0, 2]["whitened"] is None and out[0, 2]["explained"] == 0
    same = whiten(spark.createDataFrame([(1, [2.0, 3.0], ""), (1, [2.0, 3.0], "")], SCHEMA)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)


@pytest.mark.parametrize("rows", [[], [(1, None, "x")], [(1, [], "x")]])
def test_no_vectors(spark, rows):
    assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_short_vectors_are_filled(spark):
    fit = spark.createDataFrame([([1, 2, 3],), ([5],), ([],)], "x array<long>")
    model = Whitening(fit, 2)
    assert (model.n, model.sums) == (3, [6, 2, 3])
    assert model.covariance == pytest.approx(np.cov(np.array([[1, 2, 3], [5, 0, 0], [0, 0, 0]]).T, bias=True))
