"""Line de-duplication of rows that share an id or have none, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gridtally.llm.linededup import drop_repeated_lines, line_report


def test_unlike_lines_at_one_place_stay(spark):
    base = [f"w{i}" for i in range(10)]
    near = " ".join([*base[:9], "changed"])
    rows = [(1, " ".join(base)), (None, near), (None, "nothing like it at all"), (2, "twin line one"), (2, "twin line two and more")]
    kept = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(text for _, text in rows if text != near)


def test_later_copies_at_one_place_go(spark):
    rows = [(None, f"one shared line of words\nowner {'x' * i} has {'y' * i}") for i in range(1, 5)]
    report = line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(list(r.removed) for r in report) == [[], [0], [0], [0]]


@pytest.mark.parametrize("seed", range(2))
def test_rows_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice((3, 10, 25)))] for _ in range(12)]

    def line():
        return " ".join(f"v{rng.randrange(99)}" if rng.random() < 0.06 else w for w in rng.choice(bases))

    texts = ["\n".join(line() for _ in range(rng.randrange(1, 5))) for _ in range(45)]
    rows = [(rng.choice((None, 7, number)), text) for number, text in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    lines = sorted(
        (doc_id is None, doc_id or 0, number, hashes[text], tuple(sorted(set(own.split()))))
        for doc_id, text in set(rows) for number, own in enumerate(text.split("\n"))
    )
    gone, seen = {}, []
    for last, doc_id, number, h, own in lines:
        words = set(own)
        if any(len(words & w) * 100 >= len(words | w) * 80 for w in seen):
            gone.setdefault((None if last else doc_id, h), []).append(number)
        seen.append(words)
    for r in line_report(docs).collect():
        assert list(r.removed) == gone.get((r.doc_id, r.h), [])
    assert 0 < sum(map(len, gone.values())) < len(lines)
