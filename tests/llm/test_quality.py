"""Quality rules against a plain computation."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from netloom.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    n, chars = len(words), sum(map(len, words))
    return n, chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n, len(lines)


def plain_vector(s):
    n, chars, symbols, dup, repeat, _, lines = s
    return np.array([np.log1p(n), np.log((chars + 100) / (n + 20)), np.log1p(50 * symbols / max(chars, 1)), repeat / max(n, 1), dup / max(lines, 1)])


def plain_mcd(x):
    floors = np.diag(np.square(q.FLOORS))

    def distances(mean, scatter):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter + floors), d)

    def median(values):
        bins = np.sort(np.floor(values / q.WIDTH), axis=0)
        return (bins[(len(bins) - 1) // 2] + 0.5) * q.WIDTH

    middle = median(x)
    ends = []
    for mean, scatter in ((x.mean(0), np.cov(x.T, bias=True)), (middle, np.diag((1.4826 * median(abs(x - middle))) ** 2))):
        at = None
        while True:
            bins = np.floor(np.log2(distances(mean, scatter) + 1e-9) * q.FINE)
            order = np.sort(bins)
            near = x[bins <= order[int(np.ceil(q.KEEP * len(x))) - 1]]
            new = near.mean(0), np.cov(near.T, bias=True) * q.CONSISTENT
            half = np.linalg.slogdet(new[1] + floors)[1] / 2
            if at is not None and half >= at - q.SETTLED:
                break
            at, (mean, scatter) = half, new
        ends.append((at, mean, scatter))
    _, mean, scatter = min(ends, key=lambda e: e[0])
    return lambda v: float(np.sqrt((v - mean) @ np.linalg.inv(scatter + floors) @ (v - mean)))


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(700):
        n = r.choice([0, 3, 9, 10, 40, 120, 400])
        kind = r.random()
        words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(n)]
        if kind < 0.1:
            words = [w + r.choice(["###", "&&&", "|<>"]) for w in words]
        elif kind < 0.2 and n:
            words = [words[k % 7] for k in range(n)]
        elif kind < 0.25:
            words = words[: n // 2] + words[: n // 20 + 5]
        text = "".join(w + r.choice([" ", " ", "\n", "\t\n", "  "]) for w in words)
        if kind > 0.9:
            text += "same line\nsame line\n\n \n"
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "c"]) if r.random() < 0.9 else r.choice([None, "rare"])))
    return [*rows, (1, rows[1][1], "en", "a"), (None, None, None, None), (900, "a " * 30_000, "en", "a"), (901, "x " * 11 + "日本 " * 30, "de", "a")]


@pytest.mark.parametrize("least", [50, 1000])
def test_against_plain_code(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int").repartition(3)
    out = q.quality(df, least=least)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    stats = [plain_statistics(r[1]) for r in rows]
    vectors = np.array([plain_vector(s) for s in stats])
    ok = np.array([not s[5] for s in stats])
    groups = {}
    for level in ((2, 3), (2,), ()):
        keys = [tuple(r[c] for c in level) for r in rows]
        for key in set(keys):
            mine = np.array([k == key for k in keys]) & ok
            if mine.sum() >= least or level == ():
                groups[(len(level), *key)] = plain_mcd(vectors[mine])
    got = {}
    for x in out.collect():
        got.setdefault((str(x.doc_id), x.text), []).append(x)
    for r, s, v in zip(rows, stats, vectors, strict=True):
        x = got[str(r[0]), r[1]][0]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == s[:6]
        if s[5]:
            assert x.distance is None and not x.kept
            continue
        judge = next(groups[k] for k in ((2, r[2], r[3]), (1, r[2]), (0,)) if k in groups)
        assert x.distance == pytest.approx(judge(v), rel=1e-6) and x.kept == (judge(v) <= q.CUTOFF**0.5)
    assert sum(map(len, got.values())) == len(rows)


def test_empty_and_hopeless_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert q.quality(spark.createDataFrame([], schema)).collect() == []
    assert [x.kept for x in q.quality(spark.createDataFrame([(1, "few words", None, "a"), (2, None, "en", None)], schema)).collect()] == [False, False]
    assert [x.kept for x in q.quality(spark.createDataFrame([(1, " ".join(map(str, range(50))), "en", "a")], schema)).collect()] == [True]


def test_an_estimate_takes_few_steps_of_the_plan(spark):
    """Entries of the factor and its inverse that don't need each other are one projection: 15, where each had its own (31)."""
    names = [*(f"m{i}" for i in range(q.N)), *(f"c{i}{j}" for i, j in q.PAIRS)]
    made = np.random.default_rng(4).normal(size=(9, q.N))
    cov = np.cov(made.T, bias=True)
    row = ["", *map(float, made.mean(axis=0)), *(float(cov[i, j]) for i, j in q.PAIRS)]
    found = q._inverted(spark.createDataFrame([row], ["key", *names]), 1.5)
    assert found._jdf.queryExecution().analyzed().toString().count("Project") <= 16
    want = np.linalg.inv(np.linalg.cholesky(1.5 * cov + np.diag(np.square(q.FLOORS))))
    got = found.first()
    assert np.allclose([got[f"w{i}{j}"] for i, j in q.PAIRS], [want[i, j] for i, j in q.PAIRS], rtol=1e-9, atol=1e-12)
