"""Nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from gridtally.llm import chat, decontamination, linededup, mixing, nearduplicates, neighbours, warc
from gridtally.session import new_folder

LINE = "one two three four five six seven eight nine ten"
DOCS = [
    (None, LINE), (1, None), (2, ""), (3, LINE), (4, LINE + " eleven"), (4, LINE + " eleven"), (5, LINE), (6, "x"),
]


@pytest.fixture
def docs(spark):
    rows = [(*row, "s", 1, "clash") for row in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, root string")


def test_near_duplicates(docs):
    rows = nearduplicates.near_duplicates(docs, shingle=2).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in rows) == [
        (-1, 9, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 9, 3, True), (4, 10, 3, False), (4, 10, 3, False),
        (5, 9, 3, False), (6, 1, 6, True),
    ]
    assert nearduplicates.near_duplicates(docs.limit(0)).collect() == []


def test_contamination(spark, docs):
    items = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (None, LINE.upper()), (3, "")], "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(docs, items).collect()}
    assert rows == {None: (10, 10, 0), 1: (0, 0, 0), 2: (0, 0, 0), 3: (10, 10, 0), 4: (11, 10, 0), 5: (10, 10, 0), 6: (1, 1, 1)}
    assert not any(r.contaminated for r in decontamination.contamination(docs, items.limit(0)).collect())


def test_lines(docs):
    rows = sorted((r.doc_id or -1, r.n_lines, r.n_removed) for r in linededup.line_report(docs).collect())
    assert rows == [(-1, 1, 1), (1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 0)]


def test_mixing(docs):
    rows = mixing.mix_sources(docs.withColumn("copy", F.lit("clash")))
    assert rows.columns == [*docs.columns, "copy"] and rows.count() >= len(DOCS)


def test_rows_without_an_id_draw_by_their_texts(spark):
    rows = [(None, f"w{i} " * 10, "s", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    words = docs.select("source", F.lit(10).alias("size"))
    mixed = mixing.with_copies(docs, mixing.source_targets(words))
    taken = mixed.agg(F.sum("copies"), F.min("size"), F.max("size")).first()
    assert (taken[1], taken[2]) == (10, 10)  # not the column of that name
    assert 560 <= taken[0] <= 640
    assert mixing.mix_sources(docs).count() == taken[0]


def test_no_rows_to_mix(docs):
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_archives_are_read_by_tasks_of_even_bytes(spark):
    rows = [(i, f"u{i}", "".join(chr(33 + (i * j * 7919) % 900) for j in range(3000)), "x") for i in range(200)]
    pages = spark.createDataFrame([*rows, rows[7]], "page_id long, url string, html string, file string")
    folder = new_folder(spark, "warc")
    index = warc.write_warc(pages.coalesce(1), folder)
    size = index.agg(F.sum("length")).first()[0]
    records = warc.read_warc(index, folder, range_bytes=size // 40, task_bytes=size // 8)
    tasks = records.select(F.spark_partition_id().alias("task"), "page_id").groupBy("task").count().collect()
    assert len(tasks) >= 4 and sum(r["count"] for r in tasks) == 201
    found = {(r.page_id, bytes(r.payload or b"").decode()) for r in records.collect()}
    assert found == {(i, html) for i, _, html, _ in rows}
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).collect() == []


def test_names_of_shared_stores():
    store, path = warc._file_system("file:/tmp/warc")
    assert (store.type_name, path) == ("local", "/tmp/warc")
    store, path = warc._file_system("s3a://bucket/warc?region=us-east-1")
    assert (store.type_name, path) == ("s3", "bucket/warc")


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "u\r\n%", "é"), (2, None, None), (3, "v", "é"), (4, "w", ""), (4, "w", "\r\n\r\nWARC/1.1")],
        "page_id long, url string, html string",
    )
    folder = new_folder(spark, "warc")
    rows = warc.read_warc(warc.write_warc(pages, folder), folder).collect()
    assert sorted((r.page_id, r.url or "", r.record_type, r.refers_to or 0, r.payload_bytes) for r in rows) == [
        (1, "u\r\n%", "response", 0, 2), (2, "", "response", 0, 0), (3, "v", "revisit", 1, 2),
        (4, "w", "response", 0, 12), (4, "w", "revisit", 2, 0),
    ]


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (2, [0.5, 0.5]), (1, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


def test_branches_are_ranked(spark):
    rows = [("t", 1, None, "user", "<s>[\\INST]", 0.0), ("t", 2, 1, "assistant", None, 1.0),
            ("t", 3, 1, "assistant", "</s>", 2.0), ("t", 4, 3, "odd<|end|>", "z", None)]
    messages = spark.createDataFrame(rows, "tree_id string, node long, parent long, role string, text string, score double")
    formatted = chat.format_paths(chat.ranked_paths(messages)).orderBy("path").collect()
    assert [chat.parse(r.formatted) for r in formatted] == [
        [("user", "<s>[\\INST]"), ("assistant", "</s>"), ("odd<|end|>", "z")],
        [("user", "<s>[\\INST]"), ("assistant", "")],
    ]
