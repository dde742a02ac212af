"""SimHash groups and components against brute force."""

import random
import re

import pytest
import xxhash

from netloom.llm.components import components
from netloom.llm.simhash import BKTree, fingerprint, simhash_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("most", [400, 2])
def test_groups_match_brute_force(spark, most):
    r = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(50)]
    rows = []
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 4, 60, 200]))]
        rows.append((i, " ".join(words)))
        if len(words) > 50:
            for _ in range(r.choice([0, 3])):
                words[r.randint(0, len(words) - 1)] = "new"
                rows.append((1000 - len(rows), "\n".join(words)))
    rows += [(5000, None), (None, rows[3][1]), (None, "alone in its group"), (7, rows[9][1]), (8, "x " * 50_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    out = simhash_groups(df, carry=["doc_id", "fp"], most=most)
    assert out.columns == ["doc_id", "fp", "fingerprint", "component_id"]
    assert sorted(((x.doc_id, x.fingerprint, x.component_id) for x in out.collect()), key=str) == brute_groups(rows)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bk_tree_finds_all_within_radius():
    r = random.Random(4)
    items = list({r.getrandbits(10) for _ in range(200)})
    tree = BKTree()
    for x in items:
        tree.add(x)
    for x in range(0, 1024, 7):
        assert sorted(items[i] for i in tree.within(x, 2)) == sorted(y for y in items if (x ^ y).bit_count() <= 2)


def test_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 300)] + [(5, i) for i in range(6, 60)] + [(70, 70), (None, 3), (81, 80), (80, 81)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 200 for i in range(201, 301)} | {i: 5 for i in range(6, 60)} | {81: 80}


def test_no_words():
    assert fingerprint(b" \n\t") == 0 and fingerprint(b"A") == xxhash.xxh64_intdigest(b"a", 42)
