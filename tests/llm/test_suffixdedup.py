"""Repeated strings against a search through every window."""

import hashlib
import random

import duckdb
import pytest

from gridtally.llm import suffixdedup

SF_DIR = "/root/testdata/sf0.01"
SIZE = suffixdedup.MIN_BYTES


def plain(rows):
    """Bytes, removed bytes, spans and digest of each row, window by window."""
    texts = [(i is None, i or 0, (t or "").encode()) for i, t in rows]
    first = {}
    for last, doc_id, text in texts:
        for at in range(len(text) - SIZE + 1):
            window, place = text[at : at + SIZE], (last, doc_id, at)
            if place < first.setdefault(window, place):
                first[window] = place
    out = []
    for last, doc_id, text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - SIZE + 1):
            if first[text[at : at + SIZE]] < (last, doc_id, at):
                gone[at : at + SIZE] = b"\1" * SIZE
        left = bytes(b for b, g in zip(text, gone) if not g)
        spans = (b"\0" + bytes(gone)).count(b"\0\1")
        digest = hashlib.sha256(left).hexdigest()
        out.append((None if last else doc_id, len(text), sum(gone), spans, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    result = found(suffixdedup.op7_suffixes(spark, SF_DIR))
    assert result == plain(rows)
    assert sum(r[2] for r in result) > 0


@pytest.mark.parametrize("seed", range(3))
def test_small_cases(spark, seed, monkeypatch):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé \n", k=rng.choice((90, 99, 100, 101, 250)))) for _ in range(6)]
    rows = [(None, passages[0] * 2), (3, None), (3, ""), (-5, "a" * 400), (7, "ab" * 300)]
    for doc_id in rng.sample(range(100), 30):
        rows.append((doc_id, "".join(rng.choice(passages + ["x", "yz"]) for _ in range(rng.randrange(6)))))
    rows += [rows[-1], (rows[-2][0], passages[4] + passages[3])]
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 2000)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int").repartition(3)
    assert found(suffixdedup.remove_repeats(docs, texts=False)) == plain(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixdedup.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_no_group_is_larger_than_the_bound(spark, seed, monkeypatch):
    rng = random.Random(seed)
    footer, most, largest = "a short footer line that all texts have", 8, []
    passages = ["".join(rng.choices("abcdé \n", k=150)) for _ in range(3)]

    def text():
        around = ["".join(rng.choices("abcdefgh ", k=rng.choice((40, 120)))) for _ in range(2)]
        return rng.choice(passages)[: rng.randrange(150)].join(around) + footer + rng.choice([*passages, *around])

    rows = [(number, text()) for number in range(60)] + [(None, text())]
    rows += [rows[0], (103, passages[0] * 2 + footer + passages[1]), (-4, passages[0] + footer + passages[1])]
    grouped = suffixdedup._verdicts

    def watched(segments, *rest):
        largest.append(max(r["count"] for r in segments.groupBy("anchor").count().collect()))
        return grouped(segments, *rest)

    monkeypatch.setattr(suffixdedup, "_verdicts", watched)
    monkeypatch.setattr(suffixdedup, "MOST_SEGMENTS", most, raising=False)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = found(suffixdedup.remove_repeats(docs, texts=False))
    assert len(largest) == 1 and largest[0] <= most
    assert result == plain(rows)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [10**6, 700])
def test_repeated_and_missing_ids(spark, seed, size, monkeypatch):
    """Also with all rows of one id in one chunk, and with such spread over chunks."""
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abc d", k=rng.choice((100, 140, 260)))) for _ in range(4)]
    rows = [
        (rng.choice((None, 1, 1, 2, number)), "".join(rng.choice([*passages, "xy", "z" * 30]) for _ in range(rng.randrange(1, 5))))
        for number in range(12)
    ]
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", size)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert found(suffixdedup.remove_repeats(docs, texts=False)) == plain(rows)
