"""The first round of line de-duplication: each class against the earliest of its prefix words."""

import random

from gridtally.llm import linededup


def classes_of(spark):
    rng = random.Random(11)
    bases = [[f"w{rng.randrange(120)}" for _ in range(size)] for size in (4, 9, 20, 90) for _ in range(3)]
    lines = [
        " ".join(f"v{rng.randrange(40)}" if rng.random() < 0.08 else word for word in rng.choice(bases)) for _ in range(160)
    ]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return lines, linededup.lines_and_classes(docs)[1]


def test_pairs_are_the_similar_leaders_of_prefix_words(spark):
    lines, rows = classes_of(spark)
    rows = rows.collect()
    words = {r.c: set(lines[r.doc_id].split()) for r in rows}
    leaders = {}
    for r in rows:
        for key in r.prefix:
            leaders[key] = min(leaders.get(key, r.c), r.c)
    led = {(r.c, leaders[key]) for r in rows for key in r.prefix if leaders[key] < r.c}
    alike = {(x, y) for x, y in led if len(words[x] & words[y]) * 100 >= len(words[x] | words[y]) * 80}
    index = linededup.prefix_index(classes_of(spark)[1])
    found = {(r.x, r.y) for r in linededup.first_pairs(index).collect()}
    assert alike and alike <= found <= led


def test_the_index_is_shuffled_once_and_joined_with_nothing(spark):
    """Before, the leaders were counted in a shuffle of their own and joined twice."""
    pairs = linededup.first_pairs(linededup.prefix_index(classes_of(spark)[1]))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("hashpartitioning(") == 2  # the index by key, the pairs to make them distinct
