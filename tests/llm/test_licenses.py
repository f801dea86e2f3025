"""The licence scan against a plain search for the phrases."""

import random
import re

import duckdb

from gridtally.llm import licenses

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(UPPER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for start in range(len(words) - len(parts) + 1):
            if words[start : start + len(parts)] == parts:
                places.append(start)
                labels.add(label)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels))


def digest(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def test_whole_table(spark):
    found = {r.doc_id: r for r in licenses.op6_licenses(spark, SF_DIR).collect()}
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        assert digest(found[doc_id]) == plain(text)
        assert set(found[doc_id].base_labels.split(",")) - {""} <= set(found[doc_id].labels.split(","))
        assert 0 <= found[doc_id].score <= 1
    assert any(r.n_base for r in found.values())
    texts = {doc_id: text for doc_id, text in rows}
    for r in found.values():
        assert ("released under the mit license" in texts[r.doc_id].lower()) == ("mit" in r.labels.split(","))


def test_small_cases(spark, tmp_path):
    texts = [
        None, "", "CC BY cc by cc  by-cc", "General Public License" * 2 + " all rights reserved", "all rights",
        "licensed under the GNU general public general public license", "by cc cc by", "x" * 100_000 + " cc by",
        "Licensed under (the) Apache License, Version 2.0!",
    ]
    rows = [(i, text, "extra") for i, text in enumerate(texts)] + [(2, texts[2], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = licenses.op6_licenses(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert digest(r) == plain(texts[r.doc_id])
    assert {r.labels for r in found if r.doc_id == 8} == {"apache-2.0"}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(empty).collect() == []


def test_one_word_phrases(spark):
    docs = spark.createDataFrame([(1, "zzz gpl qqq"), (2, "GPL gpl"), (3, "gplx")], "doc_id long, text string")
    found = licenses.scan_licenses(docs, phrases=(("gpl", "gpl"),)).orderBy("doc_id").collect()
    assert [[p.start for p in r.places] for r in found] == [[1], [0, 1], []]


def places_in(words, template):
    """The last place of each occurrence of ``words`` in ``template``."""
    size = len(words)
    return [at + size - 1 for at in range(len(template) - size + 1) if template[at : at + size] == words]


def searched(words, templates):
    """Spans by search: matches that cannot grow, each going on at its first later place."""
    lists = [(label, text.split()) for label, text in templates]
    longest = []
    for start in range(len(words)):
        size = 0
        while start + size < len(words) and any(places_in(words[start : start + size + 1], t) for _, t in lists):
            size += 1
        longest.append(size)
    matches = [
        (start, size) for start, size in enumerate(longest)
        if size >= licenses.LEAST_MATCH and (not start or longest[start - 1] != size + 1)
    ]
    spans = []
    for label, template in lists:
        chains = []
        for start, size in matches:
            ends = places_in(words[start : start + size], template)
            if not ends:
                continue
            if chains:
                begin, end, reached, covered = chains[-1]
                later = [e for e in ends if e > reached]
                if start - end <= licenses.MOST_GAP and later:
                    new = max(min(size, later[0] - reached, start + size - end), 0)
                    chains[-1] = (begin, start + size, later[0], covered + new)
                    continue
            chains.append((start, start + size, ends[0], size))
        least = licenses.LEAST_COVERAGE * len(template)
        spans += [(label, b, e, min(c / len(template), 1.0)) for b, e, _, c in chains if c >= least]
    return sorted(spans)


def test_spans_equal_a_search(spark):
    rng = random.Random(5)
    names = "a b c d e".split()
    templates = [(f"t{i}", " ".join(rng.choice(names) for _ in range(rng.randint(6, 14)))) for i in range(6)]
    texts = []
    for i in range(150):
        words = rng.choice(templates)[1].split() if i % 3 else [rng.choice(names) for _ in range(20)]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(names + ["zz"]))
        texts.append((i, " ".join(words + rng.choice(templates)[1].split()[: rng.randint(0, 14)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in licenses.scan_licenses(docs, templates, ()).collect()}
    several = 0
    for i, text in texts:
        plain_spans = searched(text.split(), templates)
        assert sorted((s.label, s.start, s.end, s.coverage) for s in found[i]) == plain_spans, text
        several += len(plain_spans)
    assert several > 50
