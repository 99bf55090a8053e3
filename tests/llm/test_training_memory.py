"""Training holds the features of its texts once."""

from __future__ import annotations

import tracemalloc

import numpy as np

from lodestone.llm import toxicity


def test_toxicity_training_copies_no_features(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    step = np.arange(0, 1 << toxicity.BITS, 64, dtype=np.int32)
    found = [step + i % 64 for i in range(2000)]  # 33 MB
    tracemalloc.start()
    model = toxicity.fit(found, np.arange(2000) % 5 == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.learnt and peak < 32_000_000
