"""N-grams of operator 10 go to the shards with each context once, and come back as they were."""

import numpy as np

from threadmill.llm import kneser_ney as kn
from threadmill.llm.rounds import pack, unpack


def test_packed_grams_come_back_and_are_smaller():
    rng = np.random.default_rng(2)
    for context in (36, 42, 46):
        heads = rng.integers(0, 1 << context, 500, dtype=np.uint64)
        key = np.unique(heads[rng.integers(0, 500, 20_000)] << np.uint64(64 - context) | rng.integers(0, 1 << 64 - context, 20_000, dtype=np.uint64))
        blob = kn.pack_grams(key, context, count=np.ones(len(key), np.uint8))
        assert (kn.unpacked_grams(unpack(blob), context) == key).all()
        assert len(blob) < 0.9 * len(pack(key=key, count=np.ones(len(key), np.uint8)))
    one = np.array([(1 << 64) - 1], np.uint64)
    assert kn.unpacked_grams(unpack(kn.pack_grams(one, 36)), 36).tolist() == one.tolist()


def test_distinct_grams_know_their_first_place_and_counts():
    grams = kn.Grams(np.array([9, 4, 9, 4, 7], np.uint64), 36)
    assert grams.key.tolist() == [4, 7, 9] and grams.example.tolist() == [1, 4, 0] and grams.of.tolist() == [2, 0, 2, 0, 1]
    assert grams.counts(np.array([1, 0, 1, 1, 0], bool)).tolist() == [1, 0, 2]
    assert len(kn.Grams(np.zeros(0, np.uint64), 36).counts(np.zeros(0, bool))) == 0
