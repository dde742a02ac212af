"""What must not grow with all that is known of the input, for each text."""

import time

import numpy as np

from netloom.llm import near_copies as module


def test_lookup_does_not_cost_all_that_is_given():
    r = np.random.default_rng(4)
    given = np.unique(r.integers(0, 2**64, 2_000_000, np.uint64))
    sets = [np.unique(np.concatenate([r.integers(0, 2**64, 50, np.uint64), r.choice(given, 50)])) for _ in range(300)]
    began = time.perf_counter()
    got = [module.among(s, given) for s in sets]
    assert time.perf_counter() - began < 1  # a merge with all of them takes some 10 s
    for s, found in list(zip(sets, got, strict=True))[:20]:
        assert (found == np.isin(s, given)).all()
    assert not module.among(sets[0], given[:0]).any() and len(module.among(given[:0], given)) == 0


def test_shingles_are_hashed_as_before():
    import xxhash

    assert module.shingle_set(b"A b  c\td e f").tolist() == sorted(xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d e", b"b c d e f"))
    assert len(module.shingle_set(b" ")) == 0
