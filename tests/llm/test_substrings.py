"""Relative LZ and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from netloom.llm.induced import permuted_common_prefixes, repeated_windows, suffix_array
from netloom.llm.relative_lz import lz_factors, relative_lz
from netloom.llm.suffix_dedup import suffix_dedup


def brute_words(rows, width):
    least = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - width + 1):
            if i is not None and least[tuple(words[s : s + width])] < i:
                gone.update(range(s, s + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "çé", "the", "x" * 9, "zz", "q"]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 30, 80]))]
        if r.random() < 0.5:
            at, a = r.randint(0, len(words)), r.randint(0, 20)
            words[at:at] = passage[a : a + r.randint(1, 40)]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(3, rows[3][1]), (n, rows[5][1]), (n + 1, None), (None, rows[9][1]), (None, rows[9][1]), (n + 2, ""), (n + 3, "a " * 300), (4, rows[8][1])]
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, 1500), (2, 1)])
def test_relative_lz_matches_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, anchor string, n int").repartition(3)
    out = relative_lz(df, width=10, digests=True, most=most, shard_bytes=500)
    assert out.columns == ["doc_id", "text", "anchor", "n", "n_words", "n_removed", "n_spans", "kept_sha256"]
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == brute_words(rows, 10)


@pytest.mark.parametrize(("seed", "most"), [(3, 100), (4, 1)])
def test_suffix_dedup_matches_brute_force(spark, seed, most):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup(df, width=24, digests=True, most=most, shard_bytes=500)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == brute_bytes(rows, 24)


def test_texts_and_spans(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text), (2, "start " + text + " end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in relative_lz(df, width=4).collect()}
    assert rows[1].kept_text == text and rows[2].kept_text == "start end"
    assert [tuple(s) for s in rows[2].spans] == [(1, 9)]
    rows = {r.doc_id: r for r in suffix_dedup(df, width=10).collect()}
    assert bytes(rows[1].kept_text) == b"" and bytes(rows[2].kept_text) == b"start  end"
    assert [tuple(s) for s in rows[2].spans] == [(6, 45)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert relative_lz(empty, digests=True).collect() == []
    assert suffix_dedup(empty, digests=True).collect() == []


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(200):
        text = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 50))] + [0]
        sa = suffix_array(np.array(text, np.uint16), 258)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        before, common = permuted_common_prefixes(np.array(text, np.uint16), sa)
        for a, b in zip(sa.tolist()[1:], sa.tolist(), strict=False):
            k = 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert before[a] == b and common[a] == k


def test_repeated_windows():
    r = random.Random(6)
    for _ in range(100):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 5))]
        seen = Counter(p[i : i + 4] for p in parts for i in range(len(p) - 3))
        assert [x.tolist() for x in repeated_windows(parts, 4)] == [[seen[p[i : i + 4]] > 1 for i in range(len(p) - 3)] for p in parts]


def random_words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("most", [1500, 1])
def test_factors(spark, most):
    """Every factor stands in its block, with a smaller id, and can't go on there within its phrase; together they cover what a search by hand finds."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").split())
    found = lz_factors(df, width=10, most=most, shard_bytes=500).collect()
    assert found
    for f in found:
        assert f.block < f.doc_id and f.length >= 10
        own = [w[f.start : f.start + f.length] for w in texts[f.doc_id]]
        assert any(w == b[f.offset : f.offset + f.length] and len(w) == f.length for w in own for b in texts[f.block])
    assert max(f.length for f in found) > 10


def test_a_passage_with_many_surroundings(spark):
    """One passage just under the width in over 1500 different texts, and just over it in two: its blocks are cut anew."""
    r = random.Random(8)
    words, own = random_words(r, 49), [random_words(r, 70) for _ in range(1700)]
    passage = " ".join(words)
    texts = [" ".join(w[:35]) + " " + passage + " " + " ".join(w[35:]) for w in own]
    texts += [f"start {passage} goes on {own[0][0]}", f"other {passage} goes on"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = relative_lz(df, digests=True)
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in out.collect()) == brute_words(rows, 50)
    width = len(passage.encode()) + 3
    out = suffix_dedup(df, width=width, digests=True)
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out.collect()) == brute_bytes(rows, width)


def test_rows_that_agree(spark):
    """2000 equal rows, with one id, with none, and with an id each."""
    r = random.Random(9)
    text, other = " ".join(random_words(r, 600)), " ".join(random_words(r, 600))
    rows = [(7, text)] * 2000 + [(None, other)] * 2000 + [(k, other) for k in range(100, 110)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = Counter((x.doc_id, x.n_removed) for x in relative_lz(df, digests=True).collect())
    assert found == {(7, 0): 2000, (None, 0): 2000, (100, 0): 1} | {(k, 600): 1 for k in range(101, 110)}
    gone = {7: len(text), None: len(other)} | {k: len(other) for k in range(100, 110)}
    found = Counter((x.doc_id, x.n_removed) for x in suffix_dedup(df, digests=True).collect())
    assert found == {(7, gone[7]): 2000, (None, gone[None]): 2000} | {(k, gone[k]): 1 for k in range(100, 110)}


def test_texts_over_a_mebibyte(spark):
    r = random.Random(10)
    words = random_words(r, 220_000)
    copy = words[130_000:130_300]
    words[150_000:150_000] = copy  # within the text, on both sides of a cut
    text = " ".join(words)
    assert len(text) > 1 << 20
    rows = [(1, text), (2, " ".join(["x", *copy, "y"])), (3, None), (4, "a" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in relative_lz(df, digests=True).collect()}
    assert {k: x.n_removed for k, x in found.items()} == {1: 0, 2: 300, 3: 0, 4: 0} and found[1].n_words == 220_300
    found = {x.doc_id: x for x in suffix_dedup(df, digests=True).collect()}
    size = len(" ".join(copy))
    assert found[4].n_removed == 1_200_000 and found[3].n_removed == 0
    assert 2 * size <= found[1].n_removed <= 2 * size + 8 and size <= found[2].n_removed <= size + 2 and found[1].n_spans == 2
