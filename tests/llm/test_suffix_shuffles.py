"""Chunks are shuffled once, also when some anchors are too frequent to meet in one task."""

import random

from gridtally.llm import suffixdedup
from test_suffixdedup import found, plain


def test_frequent_anchors_do_not_shuffle_the_chunks_again(spark, monkeypatch):
    """Before, all chunks were shuffled a second time to be cut into windows."""
    plans, stored = {}, suffixdedup.materialize

    def watched(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, *rest)

    monkeypatch.setattr(suffixdedup, "materialize", watched)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixdedup, "MOST_SEGMENTS", 3)
    rng = random.Random(4)
    common = "".join(rng.choices("abcdefgh ", k=130))
    rows = [(i, "".join(rng.choices("abcdefgh ", k=300)) + common + "".join(rng.choices("abc", k=300))) for i in range(30)]
    rows += [rows[7], (None, rows[8][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Tables are not small enough to be broadcast at scale.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(suffixdedup.remove_repeats(docs, texts=False)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "blob" in plans["windows"] and "Exchange hashpartitioning(chunk" not in plans["windows"]
