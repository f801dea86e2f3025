"""Toxicity that shows in several words together, or in words of few texts."""

import random

import numpy as np

from gridtally.llm import toxicity

COMMON = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "su") for b in ("ren", "dol", "vak", "pim") for c in ("a", "os", "et")]
STEMS = ["grufax", "hebzon", "jiwuck", "kyxorb", "qezzil", "wubnix"]


def prose(rng, size=150):
    return [rng.choice(COMMON) for _ in range(size)]


def put(rng, text, words, within=None):
    begin = rng.randrange(len(text) - (within or len(text)) + 1)
    for word in words:
        text.insert(begin + rng.randrange(within or len(text)), word)
    return " ".join(text).encode()


def fitted(toxic, clean):
    labels = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    return toxicity.train(toxic + clean, labels, np.ones(len(labels)))


def test_several_words_together_are_told_from_one():
    rng = random.Random(3)

    def together():
        return put(rng, prose(rng), rng.choices(STEMS, k=6), 20)

    def alone():
        return put(rng, prose(rng), rng.choices(STEMS, k=1))

    model = fitted([together() for _ in range(150)], [alone() for _ in range(450)])
    found = toxicity.scores(model, [together() for _ in range(60)])
    false = toxicity.scores(model, [alone() for _ in range(60)])
    assert (found >= 0.5).mean() > 0.9 and (false >= 0.5).mean() < 0.05


def test_windows_overlap_and_end_with_their_text():
    words = toxicity._text_words([b"a " * 5, b"", b"b", b"c " * 4])
    windows = toxicity._Windows(words, 2, True)
    assert windows.text.tolist() == [0, 0, 2, 3] and windows.size.tolist() == [4, 3, 1, 4]
    value = np.arange(10.0)
    assert windows.means(value).tolist() == [1.5, 3.0, 5.0, 7.5]
    slope = np.array([4.0, 3.0, 2.0, 8.0])
    assert np.isclose(slope @ windows.means(value), windows.to_words(slope) @ value)


def test_an_insult_of_few_texts_counts():
    rng = random.Random(4)
    toxic = [put(rng, prose(rng), ["grufax"]) for _ in range(150)] + [put(rng, prose(rng), ["kyxorb"]) for _ in range(6)]
    model = fitted(toxic, [put(rng, prose(rng), ["jiwuck"]) for _ in range(650)])
    found = toxicity.scores(model, [put(rng, prose(rng), ["kyxorb"]) for _ in range(20)])
    false = toxicity.scores(model, [put(rng, prose(rng), ["jiwuck"]) for _ in range(20)])
    assert (found >= 0.5).all() and (false < 0.5).all()
