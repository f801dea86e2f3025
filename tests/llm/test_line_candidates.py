"""Candidate pairs of a large group of near copies."""

import random

import pytest

from gridtally.llm import linededup

WORDS = [f"w{i}" for i in range(4000)]


def near_copies(changes, lines=200, size=58):
    rng = random.Random(7)
    base = rng.sample(WORDS, size)
    rows = []
    for number in range(lines):
        own = list(base)
        for place in rng.sample(range(size), changes):
            own[place] = rng.choice(WORDS)
        rows.append((number, " ".join(own)))
    return rows


def similar(rows):
    sets = [set(text.split()) for _, text in rows]
    return {
        i for i, x in enumerate(sets) if any(len(x & y) * 100 >= len(x | y) * 80 for y in sets[:i] if y is not x)
    }


@pytest.mark.parametrize("changes, words", [(2, 6.5), (4, 3), (6, 3)])
def test_a_pair_is_a_candidate_at_its_first_shared_word_only(spark, changes, words):
    """Before, near copies met at each of up to 12 words that they share."""
    rows = near_copies(changes)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, classes = linededup.lines_and_classes(docs)
    index = linededup.prefix_index(classes)
    both = linededup._side(index, "x").join(linededup._side(index, "y"), "key").where(linededup._fits(80))
    assert both.count() <= words * 200 * 199 / 2
    gone = {r.doc_id for r in linededup.removed_lines(docs).collect()}
    assert gone == similar(rows)
