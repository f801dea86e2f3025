"""Exact top-k search against all pairs."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtally.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score string, rank int, vector int"


def expected(rows: list[tuple], k: int) -> list[tuple]:
    exact = lambda x: math.floor(Fraction(x) * 64)
    usable = [(i, [exact(x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        best: dict[int, int] = {}
        for own in (v for i, v in usable if i == q):
            for i, v in usable:
                if i != q and len(v) == len(own):
                    score = min(max(sum(a * b for a, b in zip(own, v)), -(2**63)), 2**63 - 1)
                    best[i] = max(best.get(i, score), score)
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def tables() -> dict[str, list[tuple]]:
    draw = random.Random(5)
    many = [(i, [draw.gauss(0, 0.2) * (1 + i % 3) for _ in range(24)]) for i in range(300)]
    ties = [(i, [float(i % 3), 1.0, -0.5]) for i in range(90)]
    odd = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-3.0, 1.0]), (20, None), (40, [math.nan, 1.0]), (60, [math.inf, 0.0]),
        (80, [None, 1.0]), (None, [1.0, 1.0]), (100, []), (120, []), (7, [0.0, 0.0]), (140, [0.0, 0.0]), (-20, [0.3, 0.7]),
        (160, [1e300, -1e300]), (161, [1e17, 3.0]), (180, [2.0**55, 2.0]), (9, [-0.001, 5e-324]), (200, [1.0]),
    ]
    return {"many": many, "ties": ties, "odd": odd, "empty": [], "one": many[:1]}


@pytest.mark.parametrize("name", tables())
def test_top_k_equals_all_pairs(spark, name):
    rows = tables()[name]
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in rows], SCHEMA).repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5, candidate_block=40, query_block=7)
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, 5)


def test_bounds_hold_and_drop_candidates(monkeypatch):
    """No pair exceeds its bound, finer bounds are closer, and far groups are never multiplied out."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 16)).repeat(4, axis=1) * 3
    x = np.floor(64 * (centers.repeat(2000, axis=0) + rng.normal(size=(12000, 64)) * 0.05))
    products = x[:200] @ x.T
    last = np.inf
    for m in topk.SEGMENTS:
        bound = topk.statistics(x[:200], m) @ topk.statistics(x, m).T
        assert (bound >= products - 1e-3).all()
        assert bound.mean() <= last + 1e-6
        last = bound.mean()
    kth = np.partition(products, -20, axis=1)[:, -20]
    fine = topk.statistics(x[:200], 16) @ topk.statistics(x, 16).T
    assert (fine >= kth[:, None]).mean() < 0.3


def test_search_over_several_chunks(monkeypatch):
    monkeypatch.setattr(topk, "_CHUNK", 16)
    monkeypatch.setattr(topk, "_SLICE", 5)
    draw = random.Random(1)
    rows = [(i, [float(draw.randint(-3, 3)) / 8 for _ in range(9)]) for i in range(200)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    asked = ids % 20 == 0
    numbers, found, scores = topk.search(ids[asked], x[asked], ids, x, 7, topk.SEGMENTS)
    mine = sorted(zip(ids[asked][numbers], found, scores))
    assert mine == sorted((q, i, s) for q, _, i, s in expected(rows, 7))
