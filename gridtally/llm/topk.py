"""Exact top-k search by inner product through segment statistics of several resolutions.

A vector is cut into segments; of each its mean and deviation are kept. Two vectors x
and y are at least sqrt(sum of len * ((mean_x - mean_y)^2 + (dev_x - dev_y)^2)) apart,
and since squared length is the sum of len * (mean^2 + dev^2), their inner product is
at most the sum of len * (mean_x * mean_y + dev_x * dev_y). Resolutions go from one
segment to short ones: a candidate whose bound falls under the k-th best score that a
query has so far is dropped, and exact products are computed for the survivors only.

Queries meet candidates in blocks of bounded size, dealt by a hash of the row, so the
work is even whatever the vectors are, and a group of equal vectors is spread. Within a
block candidates stand by falling bound of the coarsest resolution's deviation, longest
first, so that good scores are found early. Each block returns k rows a query.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.session import materialize

SCALE = 64
SEGMENTS = (1, 4, 16)
# Rows of a block, at most; and how many blocks of candidates there are at least.
CANDIDATE_BLOCK = 32_768
QUERY_BLOCK = 4_096
LEAST_BLOCKS = 24
LEAST_ROWS = 2_048
_SLICE, _CHUNK = 256, 4_096
_LONG = 2**63

FOUND = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as doubles where these are exact, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or np.abs(scaled).max() < 2.0**52:
        return scaled
    exact = np.empty(x.shape, dtype=object)
    exact[...] = [[math.floor(Fraction(float(v)) * SCALE) for v in row] for row in x]
    return exact


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the means and deviations of its segments, times the root of their length.

    The inner product of two such rows bounds that of the vectors from above.
    """
    columns = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        piece = x[:, part]
        mean = piece.mean(axis=1)
        columns += [mean, np.sqrt(((piece - mean[:, None]) ** 2).mean(axis=1))]
        columns[-2:] = [c * math.sqrt(len(part)) for c in columns[-2:]]
    return np.stack(columns, axis=1)


def _clamped(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond the range of a long become its ends."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(int(s), -_LONG), _LONG - 1) for s in scores], dtype=np.int64)


def _ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best ids of each row, ties to the smaller id."""
    order = np.lexsort((~scores, ids, rows))
    again = (np.diff(rows[order], prepend=-1) == 0) & (np.diff(ids[order], prepend=0) == 0)
    again[:1] = False
    order = order[~again]
    order = order[np.lexsort((ids[order], ~scores[order], rows[order]))]
    first = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - first < k]


def _exact(q: np.ndarray, c: np.ndarray, k: int, q_ids: np.ndarray, ids: np.ndarray) -> tuple:
    """All pairs of integers of any size, for the rare vectors that doubles cannot hold."""
    rows, found, scores = [], [], []
    for i, query in enumerate(q):
        other = np.flatnonzero(ids != q_ids[i])
        own = _clamped(np.array([sum(int(a) * int(b) for a, b in zip(query, c[j])) for j in other], dtype=object))
        best = _ranked(np.zeros(len(other), dtype=np.int64), ids[other], own, k)
        rows.append(np.full(len(best), i)), found.append(ids[other][best]), scores.append(own[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def search(
    q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, segments: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and scores of the k best ``vectors`` for each of ``queries``."""
    q, c = whole(queries), whole(vectors)
    exact_size = max(1.0, float(abs(q).max() if q.size else 0)) * max(1.0, float(abs(c).max() if c.size else 0))
    if q.dtype == object or c.dtype == object or exact_size * max(1, q.shape[1]) >= 2.0**53:
        return _exact(q, c, k, q_ids, ids)
    levels = [] if not q.shape[1] else [(statistics(q, m), statistics(c, m)) for m in segments if m < q.shape[1]]
    if levels:
        order = np.argsort(-(levels[0][1] ** 2).sum(axis=1), kind="stable")
        c, ids, levels = c[order], ids[order], [(a, b[order]) for a, b in levels]
    # Of an id with several vectors only the best score counts.
    k_rows = min(k * int(np.unique(ids, return_counts=True)[1].max(initial=1)), max(k, len(c)))
    # Doubles of the statistics are a little off; the bound must not be.
    slack = 1e-9 * exact_size * max(1, q.shape[1]) + 1e-6
    out = []
    for low in range(0, len(q), _SLICE):
        own, own_ids = q[low : low + _SLICE], q_ids[low : low + _SLICE]
        best = np.full((len(own), k_rows), -np.inf)
        kept = []
        for start in range(0, len(c), _CHUNK):
            alive = np.arange(start, min(start + _CHUNK, len(c)))
            level = best[:, 0]
            if np.isfinite(level).any():
                for of_q, of_c in levels:
                    bound = of_q[low : low + _SLICE] @ of_c[alive].T
                    alive = alive[(bound >= level[:, None] - slack).any(axis=0)]
            if not len(alive):
                continue
            scores = own @ c[alive].T
            scores[own_ids[:, None] == ids[alive][None, :]] = -np.inf
            both = np.hstack([best, scores])
            best = np.sort(np.partition(both, both.shape[1] - k_rows, axis=1)[:, both.shape[1] - k_rows :], axis=1)
            rows, columns = np.nonzero((scores >= best[:, :1]) & (scores > -np.inf))
            kept.append((rows, ids[alive[columns]], scores[rows, columns]))
        rows, found, scores = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, int),) * 3
        scores = scores.astype(np.int64)
        top = _ranked(rows, found, scores, k)
        out.append((rows[top] + low, found[top], scores[top]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _blocks(total: int, most: int) -> int:
    return max(-(-total // most), min(LEAST_BLOCKS, -(-total // LEAST_ROWS)), 1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, segments: tuple[int, ...] = SEGMENTS,
    candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of floor(64 * x).

    ``vectors`` has ``vec_id, embedding``, other columns are not looked at; ``is_query``
    picks the queries among its rows. Null vectors, such with null or non-finite
    components and rows without an id take no part; zero vectors do, with score 0. A
    query meets only vectors of its length (empty ones each other, with score 0) and no
    row of its own id. Ties go to the smaller ``vec_id``; rows that repeat an id and vector
    are one, and of several vectors under one id the best score counts. Scores beyond the
    range of a long become its ends. Nothing is approximate: bounds only drop what
    cannot be among the best.
    """
    rows = vectors.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    one = rows.groupBy("vec_id", "vector").agg(F.max("asked").alias("asked"))
    stored = materialize(one.withColumn("dim", F.size("vector")), "search_vectors")
    size = stored.agg(F.count("*").alias("rows"), F.count_if("asked").alias("asked")).first()
    c_blocks, q_blocks = _blocks(size["rows"], candidate_block), max(1, -(-size["asked"] // query_block))
    place = F.xxhash64("vec_id", "vector")
    # The last columns say which blocks of the other side a row is copied to.
    candidates = stored.select(
        "vec_id", "vector", "dim", F.pmod(place, F.lit(c_blocks)).alias("cb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"),
    )
    queries = stored.where("asked").select(
        "vec_id", "vector", "dim", F.pmod(place, F.lit(q_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"),
    )

    def block(asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or met.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = int(asked.dim.iloc[0])
        q, c = (np.array(x.vector.tolist(), dtype=np.float64).reshape(len(x), width) for x in (asked, met))
        q_ids = asked.vec_id.to_numpy()
        numbers, found, scores = search(q_ids, q, met.vec_id.to_numpy(), c, k, segments)
        return pd.DataFrame({"query_id": q_ids[numbers], "vec_id": found, "score": scores})

    keys = ["dim", "cb", "qb"]
    pairs = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(block, FOUND)
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_k`` of every twentieth id against the whole of ``embeddings``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP12_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
