"""Suffix removal holds arrays of a stretch of text and of a few groups, not of a whole batch."""

import random
import tracemalloc

import numpy as np

from gridtally.llm import suffixdedup


def test_arrays_of_a_chunk_are_bounded():
    """Before, 1 MB of text took some 90 MB."""
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcdefgh ", k=suffixdedup.CHUNK_BYTES))
    suffixdedup.Segments(data, [len(data)], 100)
    tracemalloc.start()
    found = suffixdedup.Segments(data, [len(data)], 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * len(data)
    # Every window is in exactly one segment.
    windows = np.concatenate([np.arange(s, e - 99) for s, e in zip(found.start, found.end)])
    assert sorted(windows.tolist()) == list(range(len(data) - 99))
