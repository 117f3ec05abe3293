"""A part's distinct values take little more memory than the values themselves."""

import tracemalloc

import numpy as np

from postlens.llm import jaccard


def pieces(n, most, seed=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, most, k, np.uint64) << np.uint64(20) for k in (n // 2, 0, n - n // 2)]


def test_distinct_as_unique():
    for found in (pieces(5000, 700), pieces(300, 1 << 40), [], [np.zeros(0, np.uint64)], [np.full(9, 2**64 - 1, np.uint64)]):
        want = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(jaccard.distinct(found), want, strict=True))


def test_memory_of_a_part():
    found = pieces(1_000_000, 1 << 43)
    tracemalloc.start()
    jaccard.distinct(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * 1_000_000  # np.unique: over 40 bytes a value
