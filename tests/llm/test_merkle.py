"""Hash trees against a plain recursion."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gridtally.llm.merkle import _pivoted, verified_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, path string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climbed(digests: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each digest what stands left and right of it per level."""
    paths = [[] for _ in digests]
    groups = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, merged = [], []
        for low in range(0, len(digests), fanout):
            run = digests[low : low + fanout]
            for k in range(len(run)):
                for i in groups[low + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest("".join(run)))
            merged.append([i for g in groups[low : low + fanout] for i in g])
        digests, groups = above, merged
    return digests[0], paths


def expected(rows: list[tuple], fanout: int) -> list[tuple]:
    parts: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        tampered = leaf
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            tampered = leaf_of(doc_id, source, lang, n_chars + 1, text)
        parts.setdefault(lang, []).append((doc_id, leaf, tampered))
    names = sorted(parts, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = climbed([r[1] for r in parts[name]], fanout)
    if not names:
        return []
    root, tops = climbed([trees[name][0] for name in names], fanout)
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, paths = trees[name]
        for (doc_id, leaf, tampered), path in zip(parts[name], paths, strict=True):
            steps = path + top
            found = tampered
            for left, right in steps:
                found = digest(left + found + right)
            proof = digest("".join(a + b for a, b in steps))
            out.append((doc_id, leaf, subroot, root, proof, found, found == root))
    return sorted(out, key=repr)


def tables() -> dict[str, list[tuple]]:
    many = [(i * 3, f"text {i}", ["en", "de", "é", "z"][i % 7 % 4], "s", i) for i in range(150)]
    odd = [
        (None, None, None, None, None), (None, "", None, "", 0), (5, "x", "", None, None), (5, "x", "", None, None),
        (5, "y", "", None, 3), (21, "long " * 50_000, "en", "s", 1), (-4, "ü\n", "en", "s", -1), (0, None, "en", "s", 9),
        (35, "tampered", "en", "s", 2**40), (63, "null count", "en", "s", None),
    ]
    return {"many": many, "odd": odd, "one": many[:1], "two parts": many[:2], "repeated": odd[:1] * 9 + many[:9] * 5, "empty": []}


CASES = [
    ("many", {"fanout": 2, "block_nodes": 4}), ("odd", {}), ("odd", {"fanout": 3, "block_nodes": 9}), ("one", {}),
    ("two parts", {}), ("repeated", {"fanout": 3, "block_nodes": 27}), ("empty", {}),
]


@pytest.mark.parametrize("name, options", CASES)
def test_manifest_equals_recursion(spark, name, options):
    rows = tables()[name]
    docs = spark.createDataFrame([(*row, "extra", 1, "extra") for row in rows], SCHEMA).repartition(3)
    found = sorted((tuple(r) for r in verified_manifest(docs, **options).collect()), key=repr)
    assert found == expected(rows, options.get("fanout", 2))


def test_tampered_rows_alone_fail(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(200)]
    docs = spark.createDataFrame([(*row, "", 0, "") for row in rows], SCHEMA)
    failed = {r.doc_id for r in verified_manifest(docs).where("NOT verified").collect()}
    assert failed == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0} != set()


def test_blocks_are_climbed_without_another_shuffle(spark):
    none = F.array().cast("array<struct<left:string,right:string>>")
    rows = spark.range(64).select(
        (F.col("id") % 1).cast("string").alias("tree"), F.floor(F.col("id") / 16).alias("block"), (F.col("id") % 1 + 64).alias("n"),
        F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("digest"),
        F.array(F.struct(F.col("id").alias("pos"), F.lit("").alias("item"), none.alias("path"))).alias("members"),
    ).repartition("tree", "block")
    for _ in range(4):
        rows = _pivoted(rows, 2)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
