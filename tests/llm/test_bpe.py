"""BPE and length histograms against the tiktoken library."""

import base64
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from netloom.llm import bpe
from netloom.llm.token_counts import encoded_lengths, length_histogram, length_quantile, truncated_total

DATA = Path(P.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(DATA), special_tokens={})
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n a\t b ", "don't  stop", "été là  x", "日本語 テキスト", "🙂🙂 🙂", "a" * 300, "x\x1cy \x1f z\x85w", "<|endoftext|> hi", "1234567 89", " ​ a", "é ́", "﻿ bom", "Ⅷ ² ½", "a\rb\r\n c"]


def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice([" ", "a", "the", "\n", "é", "日", "'s", "7", "!!", "\t", " "]) for _ in range(60)) for _ in range(200)]


@pytest.mark.parametrize("entries", [300_000, 5])
def test_encoder_agrees_with_tiktoken(monkeypatch, entries):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", entries)
    encoder = bpe.Encoder(DATA, P.PATTERN)
    for part in (texts()[:50], texts()[50:], texts()[:30]):
        for text, (ids, decoded) in zip(part, encoder.encode(part), strict=True):
            assert ids.tolist() == LIBRARY.encode_ordinary(text), text
            assert decoded.tobytes() == text.encode()


def test_long_matches():
    """Runs of letters of up to a megabyte: at random, of one letter, in periods, in a script without spaces."""
    r = random.Random(3)
    runs = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (255, 257, 300, 5000, 1_000_000)]
    runs += ["a" * 1_000_000, "abcdefg" * 9000, "the" * 20_000, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(30_000)), "".join(r.choice("ab") for _ in range(50_000)), "é" * 999]
    encoder = bpe.Encoder(DATA, P.PATTERN)
    for text, (ids, decoded) in zip(runs, encoder.encode(runs), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(text), text[:20]
        assert decoded.tobytes() == text.encode()


def test_vocabulary_with_smaller_ranks_after_larger_ones():
    """Tokens whose parts have larger ranks than they: contraction must stay in the library's order."""
    r = random.Random(4)
    for _ in range(20):
        tokens = {bytes([i]) for i in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens, key=lambda t: r.random())
        data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
        library = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(data), special_tokens={})
        words = ["".join(r.choice("abc") for _ in range(n)) for n in (*range(1, 40), 400, 900)]
        for text, (ids, decoded) in zip(words, bpe.Encoder(data, P.PATTERN).encode(words), strict=True):
            assert ids.tolist() == library.encode_ordinary(text) and decoded.tobytes() == text.encode()


def test_query_columns(spark):
    rows = [*enumerate(texts()), (1, None), (None, "x"), (2, "x"), (2, "x")]
    df = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = Counter(map(tuple, bpe.bpe(df, DATA, P.PATTERN, digests=True, carry=["doc_id"]).collect()))
    want = Counter()
    for i, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    full = bpe.bpe(df, DATA, P.PATTERN)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert all(x.ids == LIBRARY.encode_ordinary(x.text or "") and bytes(x.decoded) == (x.text or "").encode() for x in full.collect())


def test_histogram(spark):
    df = spark.createDataFrame([(t, 1) for t in [*texts(), None, "word " * 3000]], "text string, n_tokens int")
    lengths = encoded_lengths(df, DATA, P.PATTERN)
    want = sorted(len(LIBRARY.encode_ordinary(t or "")) for t in [*texts(), None, "word " * 3000])
    assert sorted(x.n_tokens for x in lengths.collect()) == want
    for span in (1024, 7):
        rows = length_histogram(lengths, span=span).collect()
        assert sorted(x.n_tokens for x in rows) == sorted(set(want))
        for x in rows:
            at = x.n_tokens
            assert (x.n_docs, x.docs_at_least, x.tokens_at_least) == (want.count(at), sum(n >= at for n in want), sum(n for n in want if n >= at))
            assert (x.docs_total, x.tokens_total, x.truncated_total) == (len(want), sum(want), sum(min(n, at) for n in want))
            assert x.quantile == sum(n <= at for n in want) / len(want)
    histogram = length_histogram(lengths)
    assert length_quantile(histogram, 0.5).first()[0] == want[-(-len(want) // 2) - 1]
    assert truncated_total(histogram, 100).first()[0] == sum(min(n, 100) for n in want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe(empty, DATA, P.PATTERN, digests=True).collect() == []
    assert length_histogram(encoded_lengths(empty, DATA, P.PATTERN)).collect() == []
