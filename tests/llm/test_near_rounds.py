"""Rounds over keys that hold several components, and the files of few labels."""

import random

from gridtally.llm import nearduplicates


def test_few_edges_are_labelled_by_few_tasks(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    spark.conf.set(coalesce, "false")
    try:
        labels = nearduplicates.components(edges, "few")
    finally:
        spark.conf.unset(coalesce)
    assert len(labels.inputFiles()) == 1
    assert {r.node: r.label for r in labels.collect()} == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_every_round_meets_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "FIRST_RANKS", 2)
    chance = random.Random(5)
    texts = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(30)]
        for _ in range(15):
            words = list(base)
            for place in chance.sample(range(30), chance.choice([1, 2, 3])):
                words[place] = f"x{chance.random()}"
            texts.append((len(texts), " ".join(words)))
    sets = [{tuple(words[i : i + 2]) for i in range(len(words) - 1)} for words in (t.split() for _, t in texts)]
    label = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    found = nearduplicates.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=2)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(label))
    assert 4 < len(set(label)) < len(label)
