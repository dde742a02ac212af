"""The mixing schedule against plain arithmetic."""

import random
import re

from netloom.llm.mixing import Mix, source_targets


def water_fill(sizes, weights, most):
    """Shares the excess again until no target is above its limit."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        share = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * weights[i] / share for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i]}
        if not more:
            return target
        full |= more


def corpus():
    r = random.Random(8)
    rows = []
    for i in range(900):
        source = "hot" if r.random() < 0.4 else r.choice(["a", "é", "z", "Z", None, "tiny"][: 5 if r.random() < 0.9 else 6])
        rows.append((i, " ".join(r.choice(["w", "xx", "yé"]) for _ in range(r.choice([0, 1, 30, 200, 900]))), source))
    return [*rows, (3, rows[3][1], rows[3][2]), (None, "a b c", "a"), (7000, None, "only null"), (7001, "t " * 5000, "z")]


def test_targets(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = [r.choice([0, 1, 10, 1000, 5000]) for _ in range(7)]
        names = ["B", "a", "b", "é", "日", "", None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {x.source: x.target for x in source_targets(df).collect()}
        order = sorted(range(7), key=lambda i: (names[i] is None, (names[i] or "").encode()))
        want = water_fill([sizes[i] for i in order], [1 + k % 3 for k in range(7)], 3) if sum(sizes) else [0] * 7
        for i, t in zip(order, want, strict=True):
            assert abs(got[names[i]] - t) <= 1e-6 * max(t, 1)


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, source string, taken int").repartition(5)
    mix = Mix(df)
    out = mix.documents()
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = out.collect()
    assert sorted(map(str, [(x.doc_id, x.text, x.source) for x in got])) == sorted(map(str, rows))
    for x in got:
        assert x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
        assert 0 <= x.taken <= 3 * x["size"]
    for s in {x.source for x in got}:
        part = [x for x in got if x.source == s]
        assert {x.source_size for x in part} == {sum(x["size"] for x in part)}
        assert abs(sum(x.taken for x in part) - part[0].target) <= 3 * 128
    again = sorted(map(str, Mix(df.repartition(2)).documents().collect()))
    assert again == sorted(map(str, got))
    slots = mix.slots.collect()
    for sid in {x.sid for x in slots}:
        mine = sorted((x.slot, x["rank"]) for x in slots if x.sid == sid)
        assert [r for _, r in mine] == list(range(len(mine)))
    texts = mix.texts().collect()
    words = {}
    for x in texts:
        words[x.source] = words.get(x.source, 0) + len(x.text.split())
    for s, n in words.items():
        assert n == sum(x.taken for x in got if x.source == s)
    whole = {(x.doc_id, x.text) for x in got}
    assert sum((x.doc_id, x.text) not in whole for x in texts) <= len(words)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Mix(empty).documents().collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(x["size"], x.taken) for x in Mix(nothing).documents().collect()] == [(0, 0), (0, 0)]
