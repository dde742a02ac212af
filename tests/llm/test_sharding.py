"""Histogram sort sharding against a plain sort."""

import random
import zlib

import pytest

from netloom.llm.histogram_sort import find_splitters, histogram_sort, shard_documents


def check(rows, n_shards, tolerance, heaviest):
    """rows: (key, size, shard, slot); shards are ranges of the keys (rows that agree in all keys may part), near equal, with gapless slots."""
    total = sum(r[1] for r in rows)
    by = {}
    for r in sorted(rows):
        by.setdefault(r[2], []).append(r)
    last = None
    for shard in sorted(by):
        part = by[shard]
        assert last is None or last <= part[0][0]
        last = part[-1][0]
        assert [r[0] for r in sorted(part, key=lambda r: r[3])] == sorted(r[0] for r in part)
        assert sorted(r[3] for r in part) == list(range(len(part)))
    for shard in range(n_shards):
        assert abs(sum(r[1] for r in by.get(shard, [])) - total / n_shards) <= 2 * max(tolerance * total / n_shards, heaviest) + 1


@pytest.mark.parametrize("kind", ["uniform", "narrow", "hot", "wide"])
def test_sort(spark, kind):
    r = random.Random(kind)
    draw = {
        "uniform": lambda: (r.randint(-(1 << 63), (1 << 63) - 1), 0),
        "narrow": lambda: (r.randint(0, 300), r.randint(-5, 5)),
        "hot": lambda: (7, r.randint(-(1 << 63), (1 << 63) - 1)) if r.random() < 0.5 else (r.randint(-9, 9), r.randint(0, 50)),
        "wide": lambda: (r.choice([-(1 << 63), (1 << 63) - 1, 0, -1]), r.choice([-(1 << 63), (1 << 63) - 1, r.randint(0, 1 << 40)])),
    }[kind]
    data = [(*draw(), r.randint(1, 30)) for _ in range(1500)]
    out = histogram_sort(spark.createDataFrame(data, "a long, b long, size int").repartition(3), ["a", "b"], "size", 8, 0.002).collect()
    assert sorted((x.a, x.b, x.size) for x in out) == sorted(data)
    check([((x.a, x.b), x.size, x.shard, x.slot) for x in out], 8, 0.002, 30)


def test_splitters_are_exact(spark):
    data = [(i * i % 1000 - 500, 1 + i % 3) for i in range(800)]
    found = find_splitters(spark.createDataFrame(data, "k long, size long"), ["k"], "size", [(300, 0), (900, 5)])
    for s in found:
        below = [x for x in data if (x[0] + (1 << 63),) < s.bound] if s.bound else data
        assert (len(below), sum(x[1] for x in below)) == (s.below_rows, s.below_bytes)


def test_documents(spark):
    r = random.Random(2)
    rows = [(i, "same text " * 20 if r.random() < 0.34 else "x" * r.randint(0, 400)) for i in range(600)] + [(5, None), (None, "é"), (None, "é"), (7, ""), (9, "long " * 400)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, size int, shard int")
    out = shard_documents(df)
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    assert sorted(map(str, [(x.doc_id, x.text) for x in got])) == sorted(map(str, rows))
    for x in got:
        data = (x.text or "").encode()
        assert x.size == len(data) + 1 and x.text_crc32 == zlib.crc32(data)
    total = sum(x["size"] for x in got)
    for s in range(8):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
        assert abs(sum(x["size"] for x in got if x.shard == s) - total / 8) <= 2001


def test_small_tables(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [(x.shard in range(8), x.slot) for x in shard_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()] == [(True, 0)]


def test_rows_that_agree_are_split(spark):
    df = spark.createDataFrame([(None, "the same text")] * 3000 + [(i, "x" * 13) for i in range(800)], "doc_id long, text string").repartition(3)
    got = shard_documents(df).collect()
    for s in range(8):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(475))
