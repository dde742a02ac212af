"""The pipeline's suffix stage on planted passages of just over 50 words."""

import random

import corpus_pipeline as pipeline


def test_passages_of_51_words_go(spark):
    r = random.Random(6)
    word = lambda low, high: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high)))
    passages = [" ".join(word(3, 7) for _ in range(51)) for _ in range(6)]
    assert all(pipeline.REPEATED < len(p) < 400 for p in passages)
    own = [[" ".join(word(3, 8) for _ in range(60)) for _ in range(2)] for _ in range(24)]
    texts = [f"{a} {passages[i % 6]} {b}" for i, (a, b) in enumerate(own)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {x.doc_id: x.text for x in pipeline.suffix_array_dedup(spark, docs, "").collect()}
    for i, (a, b) in enumerate(own):
        assert not set(passages[i % 6].split()[1:-1]) & (set(found[i].split()) - set(a.split()) - set(b.split()))
        assert len(found[i]) >= len(a) + len(b) - 12
