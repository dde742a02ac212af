"""Groups of near copies against all Jaccard similarities."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from netloom.llm import near_copies as module
from netloom.llm.near_copies import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def table():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(90):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 4, 7, 12, 40, 120, 300]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.choice([0, 1, 4])):  # each change of a word takes five shingles
            copy = list(words)
            for _ in range(r.choice([0, 1, 2, max(1, len(words) // 60), max(1, len(words) // 40)])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), "\n".join(copy)))
    rows += [(5000, None), (5001, ""), (None, rows[3][1]), (None, "alone in its group"), (7, rows[9][1]), (8, "x " * 5000)]
    return rows


@pytest.mark.parametrize("lot", [4_000_000, 3])
def test_groups_match_brute_force(spark, lot, monkeypatch):
    monkeypatch.setattr(module, "LOT", lot)
    rows = table()
    roots = brute(rows)
    least = {g: min((d for (d, _), k in zip(rows, roots, strict=True) if k == g and d is not None), default=None) for g in roots}
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((x.doc_id, x.text, x.component_id) for x in found), key=str) == sorted(((d, t, least[g]) for (d, t), g in zip(rows, roots, strict=True)), key=str)


def test_parities_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    for n in (1, 5, 9, 45, 148, 460, 512, 513, 700, 1024, 1025, 5000, 40000):
        apart = n * 2 // 9  # shingles that the two sets have alone, at most, if they are of equal sizes
        for alone in {0, apart // 4, apart // 2}:
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([r.permutation(a)[alone:], r.integers(0, 1 << 63, alone, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            assert module.alike(a, b, 80)
            bits = int(np.bitwise_count(module.parities(a) ^ module.parities(b)).sum())
            assert bits <= module.most_apart(np.array([len(a)]), np.array([len(b)]), 80)[0]


def test_parities_rule_out_texts_that_share_little():
    r = np.random.default_rng(5)
    for n in (20, 148, 500, 1000, 30000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[: n // 3], r.integers(0, 1 << 63, n - n // 3, dtype=np.uint64)]))
        bits = int(np.bitwise_count(module.parities(a) ^ module.parities(b)).sum())
        assert bits > module.most_apart(np.array([len(a)]), np.array([len(b)]), 80)[0]


def test_stage_leaves_no_pair(spark):
    rows = [(i, t, "en", "a", len(t or "")) for i, t in table()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [shingles(x.text) for x in pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert len(kept) == len(set(brute(rows)))
    assert not any(alike(a, b) for i, a in enumerate(kept) for b in kept[:i])


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_group_of_near_copies(spark):
    """Near copies of one text, and others that share a passage with it: all in one shard of many keys."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(250):
        words = list(base)
        words[r.randint(0, 299)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(250, 300):
        rows.append((i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(r.choice([5, 10, 200]))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = {}
    for (i, _), g in zip(rows, brute(rows), strict=True):
        groups.setdefault(g, []).append(i)
    got = {}
    for x in near_copies(df).collect():
        got.setdefault(x.group, []).append(x.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_a_common_passage_makes_no_pairs(spark):
    """1500 texts that share a passage and nothing else: the shingles of the passage are read last, so no pair of them is looked at."""
    r = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([*(f"a{r.randint(0, 10**9)}" for _ in range(40)), passage, *(f"b{r.randint(0, 10**9)}" for _ in range(40))])) for i in range(1500)]
    rows.append((1500, rows[7][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, __text string").repartition(3)
    found = module.described(df, 5, 80, 42).withColumn("root", F.col("cls"))
    assert [sorted(x) for x in module.candidates(module.shared_keys(found), found, 80, True).collect()] == [sorted(x.cls for x in found.where("doc_id IN (7, 1500)").collect())]
    got = near_copies(df.withColumnRenamed("__text", "text")).collect()
    assert len({x.group for x in got}) == 1500 and {x.component_id for x in got if x.doc_id in (7, 1500)} == {7}


def test_first_rows_are_chosen_without_their_texts(spark):
    """One row of each group, the same as by a window over it; the texts travel once."""
    base = [f"word{i}" for i in range(60)]
    rows = [(1, " ".join(base), "b"), (1, " ".join([*base, "more"]), "a"), (2, " ".join(base), "c"), (3, "alone here", "c"), (3, "alone here", "c"), (None, "no id", "a"), (None, "no id", "a"), (4, None, "a"), (5, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = near_copies(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = Window.partitionBy("group").orderBy(F.xxhash64("text"), "lang")
    want = plain.withColumn("i", F.row_number().over(same)).where("i = 1").select("doc_id", "text", "lang").collect()
    found = near_copies(docs, first=["lang"])
    assert sorted(map(str, found.select("doc_id", "text", "lang").collect())) == sorted(map(str, want)) and len(want) == 4
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_comes_from_the_shard_of_its_first_shared_key(spark):
    """Two texts that share most of their keys meet in every one of those shards, but few of them give the pair."""
    base = [f"w{i * i}" for i in range(300)]
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join([*base[:-1], "other"]))], "doc_id long, __text string")
    found = module.described(df, 5, 80, 42).withColumn("root", F.col("cls"))
    keys = module.shared_keys(found)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pairs = module.met(keys, found, 80, True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert keys.select("key").distinct().count() > 40 and len(set(pairs)) == 1 and len(pairs) <= 3
