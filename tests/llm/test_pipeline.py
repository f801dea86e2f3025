"""The pipeline against a plain version of its stages."""

import hashlib
import re
from collections import defaultdict

import duckdb

import corpus_pipeline
from gridtally.llm import toxicity

SF_DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def similar(a, b, percent=80):
    return 100 * len(a & b) >= percent * len(a | b) if a and b else False


def without_repeated_lines(docs):
    seen, out = [], []
    for doc in docs:
        kept, had = [], False
        for line in (doc[1] or "").split("\n"):
            words = frozenset(SPACED.findall(line.lower()))
            had = had or bool(words)
            if not any(similar(words, other) for other in seen):
                kept.append(line)
            if words:
                seen.append(words)
        text = "\n".join(kept) if doc[1] is not None else None
        if not had or SPACED.search(text):
            out.append((doc[0], text, *doc[2:]))
    return out


def without_near_duplicates(docs):
    sets, group = {}, {}
    for doc in docs:
        words = SPACED.findall((doc[1] or "").translate(UPPER))
        sets[doc[0]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        group[doc[0]] = doc[0]
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if group[a] != group[b] and similar(sets[a], sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return [doc for doc in docs if group[doc[0]] == doc[0]]


def without_benchmark(docs, items):
    windows = defaultdict(set)
    for (text,) in items:
        words = PLAIN.findall((text or "").translate(UPPER))
        for i in range(max(len(words) - 9, 1) if words else 0):
            windows[len(words[i : i + 10])].add(tuple(words[i : i + 10]))
    out = []
    for doc in docs:
        words = PLAIN.findall((doc[1] or "").translate(UPPER))
        hit = any(tuple(words[i : i + n]) in own for n, own in windows.items() for i in range(len(words) - n + 1))
        if not hit:
            out.append(doc)
    return out


def mixed(docs):
    size = {doc[0]: len(SPACED.findall(doc[1] or "")) for doc in docs}
    total = defaultdict(int)
    for doc in docs:
        total[doc[3]] += size[doc[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    rows = []
    for doc in docs:
        s = doc[3]
        rate = (2 * total[s] if s in capped else level * weight[s]) / total[s] if total[s] else 0
        key = hashlib.md5((doc[1] or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{doc[0]}:{key}".encode()).hexdigest()[:13], 16) / 16**13
        copies = int(rate) + (draw < rate - int(rate))
        rows += [(*doc, copy) for copy in range(1, copies + 1)]
    return rows


def test_run(spark):
    connect = duckdb.connect()
    docs = connect.execute(f"SELECT * FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    items = connect.execute(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    model = toxicity.fit(
        spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    )
    score = toxicity.scores(model, [(doc[1] or "").encode() for doc in docs])
    expected = [doc for doc, s in zip(docs, score) if s < 0.5]
    for step in (without_repeated_lines, without_near_duplicates):
        expected = step(expected)
    expected = mixed(without_benchmark(expected, items))
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert sorted(tuple(r) for r in result.collect()) == sorted(expected)


def test_stages_keep_odd_rows(spark):
    rows = [
        (1, None, "en", None, 0, "a"), (2, "", "en", "s", 0, "b"), (2, "", "en", "s", 0, "b"),
        (None, "one two three four five six", None, "s", 27, None), (4, "x " * 20_000, "en", "s", 40_000, "c"),
        (5, "\n\n", "en", "s", 2, "d"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert out.count() == len(rows), name
    mixed_rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert mixed_rows.columns == [*docs.columns, "copy"]
    assert mixed_rows.count() > 0


def test_stages_take_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
