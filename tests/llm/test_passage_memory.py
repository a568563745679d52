"""Memory of a worker that cuts texts."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from quillgraph.llm import passages


def held(size):
    """Peak bytes while texts of ``size`` bytes together are cut and banded."""
    r = random.Random(1)
    data = "\n".join(" ".join(str(r.randrange(10**5)) for _ in range(40)) for _ in range(size // 230)).encode()[:size]
    tracemalloc.start()
    cut = passages.Cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    for _, spans, of in cut.kinds():
        spans.band_keys(of, *passages.tuned_bands())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_slice_of_texts_takes_little_memory():
    assert held(passages.SLICE_BYTES) < 30 << 20
