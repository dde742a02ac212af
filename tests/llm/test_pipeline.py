"""Each stage of the pipeline against a plain computation on its own input."""

import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from netloom.llm.bpe import read_ranks
from netloom.llm.quality import quality
from tests.llm.test_near_copies import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "tag"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = []
    passage = " ".join(f"shared{i}é" for i in range(80))
    for i in range(220):
        words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8))) for _ in range(r.choice([4, 60, 150, 300]))]
        kind = r.random()
        if kind < 0.15:
            words = [w + "###" for w in words]
        text = " ".join(words)
        if kind > 0.8:
            text = f"{text[:300]} {passage} {text[300:]}"
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["a", "b", None])))
        if 0.4 < kind < 0.6:
            rows.append((1000 + i, text, "en", "a"))
    rows += [(5, rows[5][1], "en", "a"), (None, rows[9][1], "en", "b"), (3000, None, None, None), (3001, "", "en", "a")]
    return spark.createDataFrame([(*x, len(x[1] or ""), "t") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, tag string").repartition(3)


def test_stages(spark, docs, tmp_path):
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mix", "byte_bpe"]
    rows = {}
    at = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, "")
        out.write.parquet(str(tmp_path / stage.__name__))
        at = spark.read.parquet(str(tmp_path / stage.__name__))
        rows[stage.__name__] = at.collect()
        if name != pipeline.STAGES[-1][0]:
            assert at.columns == COLUMNS
            assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in rows[stage.__name__]) or stage.__name__ in ("quality_rules", "simhash_near_dedup")
    judged = quality(docs).collect()
    assert sorted(str((x.doc_id, x.text)) for x in judged if x.kept) == sorted(str((x.doc_id, x.text)) for x in rows["quality_rules"])
    assert any(not x.base_failed and not x.kept for x in judged)

    kept = [(x.doc_id, x.text) for x in rows["quality_rules"]]
    least = {}
    for (i, _), group in zip(kept, brute(kept), strict=True):
        least[group] = min((k for k in (least.get(group), i) if k is not None), default=None)
    assert sorted(x.doc_id for x in rows["simhash_near_dedup"]) == sorted(least.values())

    width = pipeline.REPEATED
    texts = {x.doc_id: x.text.encode() for x in rows["simhash_near_dedup"]}
    seen = {}
    for t in texts.values():
        for s in range(len(t) - width + 1):
            seen[t[s : s + width]] = seen.get(t[s : s + width], 0) + 1
    assert max(seen.values()) > 1
    for x in rows["suffix_array_dedup"]:
        t = texts[x.doc_id]
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if seen[t[s : s + width]] > 1:
                gone[s : s + width] = True
        assert x.text == bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore")

    before = {x.doc_id: x for x in rows["suffix_array_dedup"]}
    sizes, taken = {}, {}
    for x in before.values():
        sizes[x.source] = sizes.get(x.source, 0) + len(x.text.split())
    for x in rows["source_mix"]:
        assert x.text == before[x.doc_id].text or before[x.doc_id].text.split()[: len(x.text.split())] == x.text.split()
        taken[x.source] = taken.get(x.source, 0) + len(x.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    for i, s in enumerate(order):
        assert abs(taken[s] - sum(sizes.values()) * (1 + i % 3) / sum(1 + k % 3 for k in range(len(order)))) <= 3 * 128

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    mixed = sorted(library.encode_ordinary(x.text) for x in rows["source_mix"])
    assert sorted(x.ids for x in rows["byte_bpe"]) == mixed and all(x.round_trip for x in rows["byte_bpe"])


def test_run_and_queries(spark):
    from netloom.llm import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    names = [f"op{n}_" for n in range(1, 11)]
    assert [sum(q.startswith(n) for q in queries.QUERIES) for n in names] == [1] * 10
    db = duckdb.connect()
    for t in ("pages", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = sorted(map(tuple, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str)
        assert got == sorted(db.sql(sql).fetchall(), key=str)
