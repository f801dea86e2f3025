"""Reply trees with circles and long conversations."""

import time

from gridtally.llm import chat

MESSAGE = "tree_id long, node long, parent long, role string, text string, score double"


def test_circles_and_what_answers_them_are_left_out(spark):
    rows = [
        (1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "tail", 0.0), (1, 4, 4, "user", "self", 0.0),
        (1, 5, 3, "user", "tail of a tail", 0.0), (1, 6, None, "user", "root", 0.0), (1, 7, 6, "assistant", "reply", 0.0),
        (2, 1, None, "user", "alone", 0.0), (3, 1, 1, "user", "only a circle", 0.0),
    ]
    turns = chat.ranked_paths(spark.createDataFrame(rows, MESSAGE)).collect()
    assert sorted((t.tree_id, t.path, t.turn, t.text) for t in turns) == [
        (1, 0, 0, "root"), (1, 0, 1, "reply"), (2, 0, 0, "alone"),
    ]


def test_no_messages(spark):
    assert chat.format_paths(chat.ranked_paths(spark.createDataFrame([], MESSAGE))).collect() == []


def test_a_conversation_of_ten_thousand_turns(spark):
    n = 10_000
    turns = spark.range(n).selectExpr(
        "1L AS tree_id", "0L AS path", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('[INST] ', id) AS text"
    )
    began = time.time()
    row = chat.format_paths(turns).first()
    assert time.time() - began < 30
    said = chat.parse(row.formatted)
    assert said == [("assistant" if i % 2 else "user", f"[INST] {i}") for i in range(n)] and row.n_turns == n
    learnt = [chat.unescape(row.formatted[s["start"] : s["end"]]) for s in row.loss]
    assert learnt == [f"[INST] {i}" for i in range(1, n, 2)]
