"""Training holds the units of its words once, and arrays of a block of texts, in the driver."""

import random
import tracemalloc

import numpy as np

from gridtally.llm import toxicity


def test_arrays_of_training_are_bounded(monkeypatch):
    """Before, 170 MB: every unit took 16 bytes besides what an epoch made of it."""
    monkeypatch.setattr(toxicity, "MEAN_EPOCHS", 1)
    monkeypatch.setattr(toxicity, "WORST_EPOCHS", 1)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 14))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=250)).encode() for _ in range(800)]
    labels = np.arange(800) % 2
    tracemalloc.start()
    model = toxicity.train(texts, labels.astype(float), np.ones(800))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.weights).all() and model.weights.any()
    assert most < 110e6
