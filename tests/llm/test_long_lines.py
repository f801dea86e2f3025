"""Long lines that share words but are not similar make no pairs."""

import random

from gridtally.llm import linededup


def test_unlike_long_lines_make_few_pairs(spark):
    """64 parity bits of 150 words tell nothing, so most pairs that share a rare word passed."""
    rng = random.Random(3)
    lines = [" ".join(rng.sample([f"w{i}" for i in range(900)], 150)) for _ in range(150)]
    near = lines[7].split()
    lines.append(" ".join([*near[:-6], *[f"new{i}" for i in range(6)]]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    _, rows = linededup.lines_and_classes(docs)
    index = linededup.prefix_index(rows)
    pairs = linededup._similar(linededup._side(index, "x"), linededup._side(index, "y"), 80)
    assert 1 <= pairs.count() <= len(lines)
    removed = [r.doc_id for r in linededup.line_report(docs).where("n_removed > 0").collect()]
    assert removed == [150]
