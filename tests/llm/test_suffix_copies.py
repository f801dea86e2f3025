"""Copies of whole texts are settled by content and place; only differing segments carry text."""

import random

from pyspark.sql import functions as F

from gridtally.llm import suffixdedup
from test_suffixdedup import found, plain


def sent(spark, rows, monkeypatch):
    seen, grouped = [], suffixdedup._verdicts

    def watched(segments, *rest):
        seen.append(segments.agg(F.count("*"), F.sum(F.octet_length("text"))).first())
        return grouped(segments, *rest)

    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixdedup, "_verdicts", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = suffixdedup.remove_repeats(docs, texts=False)
    assert found(result) == plain(rows)
    return result, seen[0]


def test_copies_send_no_text_and_nothing_is_broadcast(spark, monkeypatch):
    """Before, each segment of a copy was sent with its 100 to 176 bytes."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=900)) for _ in range(8)]
    rows = [(i, texts[i % 8]) for i in range(40)] + [(3, texts[3]), (None, texts[0])]
    result, (segments, size) = sent(spark, rows, monkeypatch)
    assert segments > 100 and not size
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_that_share_parts_only(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts)[rng.randrange(80) :] for _ in range(3))) for i in range(30)]
    rows += [rows[4], (rows[5][0], rows[6][1])]
    _, (segments, size) = sent(spark, rows, monkeypatch)
    assert 0 < size < 176 * segments
