"""Benchmark passages of every size with every allowed set of substitutions."""

import itertools
import math

import numpy as np
import pytest

from xrdlake.llm import decontaminate


@pytest.mark.parametrize("size", range(5, 15))
def test_no_substitutions_are_lost(size):
    words = [f"w{i}" for i in range(size)]
    items = decontaminate.Items([(1, " ".join(words)), (2, "of four words only")])
    window = min(13, size)
    for k in range(window + 1):
        for places in itertools.combinations(range(window), k):
            doc = ["a", "b"] + [f"z{i}" if i in places else w for i, w in enumerate(words[:window])] + ["c"] * 20
            h = decontaminate.word_hashes([w.encode() for w in doc])
            found = items.leaks(h, np.zeros(len(doc), np.int64))
            if k <= window - math.ceil(window * 0.8):
                assert found == [(0, 0, 2, window - k, window)]
            elif size <= 13:
                assert not found
        if k > 3:
            break
