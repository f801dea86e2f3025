"""Nearest neighbours against all pairs, with odd vectors."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtally.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, score string, code int, dim int"


def expected(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, set()).add(tuple(v))
    out = []
    for q in sorted(i for i in usable if i % 20 == 0):
        best = {}
        for own in usable[q]:
            for i, vectors in usable.items():
                for v in vectors:
                    if i != q and len(v) == len(own):
                        score = 0.0
                        for a, b in zip(v, own):
                            score += a * b
                        best[i] = max(best.get(i, score), score)
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def tables():
    draw = random.Random(2)
    many = [(i, [draw.gauss(0.1, 1) for _ in range(20)]) for i in range(260)]
    odd = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [math.inf, 1.0]), (40, [-math.inf, 1.0]), (60, [math.nan, 0.0]), (80, None),
        (100, [0.0, 0.0]), (120, []), (None, [1.0, 1.0]), (1, [None, 2.0]), (2, [3.0, -1.0]), (140, [3.0, -1.0]), (-20, [0.5, 0.5]),
        (160, [1.0] * 9), (3, [2.0] * 9), (180, [5.0]),
    ]
    return {"many": many, "odd": odd, "empty": [], "equal": [(i, [1.0, 2.0, 3.0]) for i in range(70)]}


@pytest.mark.parametrize("name", tables())
def test_nearest_equals_all_pairs(spark, name):
    rows = tables()[name]
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA).repartition(3)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=5, code_block=60, query_block=5)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 5)


def test_few_vectors_are_reranked_and_bits_stay_packed(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    center = x.mean(axis=0)
    made = []
    monkeypatch.setattr(neighbours.np, "unpackbits", lambda *a, **b: made.append(a), raising=False)

    class Rows:
        def mapInPandas(self, encode, schema):
            return pd.concat(encode(iter([pd.DataFrame({"vec_id": np.arange(6000), "vector": list(x)})])))

    codes = neighbours.build_index(Rows(), {64: center})
    reranked, lexsort = [], np.lexsort
    monkeypatch.setattr(neighbours.np, "lexsort", lambda keys: reranked.append(len(keys[0])) or lexsort(keys))
    found = neighbours._search_block(codes[::20], codes, center, 20, 256, neighbours.EPSILON, neighbours.SEED)
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -2
    true = np.argsort(-scores, axis=1)[:, :20]
    hit = sum(len(set(found.vec_id[found.query_id == i * 20]) & set(row.tolist())) for i, row in enumerate(true))
    assert hit / 6000 >= 0.999 and not made
    assert sum(reranked) < 0.4 * 300 * 6000
