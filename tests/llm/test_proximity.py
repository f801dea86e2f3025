"""Proximity matches against a search of every span of every text."""

import random
import re

from pyspark.sql import functions as F

from gridtally.llm import decontamination

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, window, span):
    found = set()
    for doc_id, text in docs:
        held = split(text)
        spans = [set(held[i : i + span]) for i in range(max(len(held) - span, 0) + 1)]
        for item_id, passage in items:
            listed = split(passage)
            if item_id is None or not listed:
                continue
            cuts = [set(listed[i : i + window]) for i in range(max(len(listed) - window, 0) + 1)]
            if any(cut <= near for cut in cuts for near in spans):
                found.add((doc_id, item_id))
    return found


def passages(spark, docs, items, window=decontamination.WINDOW, span=2 * decontamination.WINDOW):
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    documents = documents.withColumn("wid", F.lit("clash")).withColumn("pos", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.near_passages(documents, benchmark, window, span)
    return sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr)


def test_inserted_and_reordered_passages(spark):
    draw = random.Random(5)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 12, 14])))) for i in range(12)]
    items += [(None, items[0][1]), (3, "Also THIS one"), (50, None), (51, ""), (52, "solo")]
    docs = [(None, None), (None, "solo"), (0, ""), (1, "also x, this y. one")]
    for doc_id in range(2, 60):
        chosen = draw.choice(items[:12])[1].split()
        if doc_id % 3 == 0:
            draw.shuffle(chosen)
        for _ in range(draw.choice([0, 2, 6, 12])):
            chosen.insert(draw.randrange(len(chosen)), draw.choice(vocabulary))
        before, after = draw.choices(vocabulary, k=draw.choice([0, 30])), draw.choices(vocabulary, k=25)
        docs.append((doc_id, " ".join([*before, *chosen, *after])))
    docs.append(docs[7])
    for window, span in ((10, 20), (10, 10), (4, 6)):
        expected = sorted(brute_force(docs, items, window, span), key=repr)
        assert passages(spark, docs, items, window, span) == expected
        assert len(expected) > 10


def test_exact_occurrences_are_near(spark):
    text = "a b c d e f g h i j k l"
    docs = [(1, f"x {text.upper()} y"), (2, "l k j i h g f e d c b a"), (3, " z ".join(text.split())), (4, "a b c")]
    assert passages(spark, docs, [(7, text)]) == [(1, 7), (2, 7), (3, 7)]
    assert passages(spark, docs, [(7, text)], span=10) == [(1, 7), (2, 7)]


def test_empty_tables(spark):
    assert passages(spark, [], [(1, "a b")]) == []
    assert passages(spark, [(1, "a b")], []) == []
