"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector is centred, padded with zeros to ``bits`` dimensions, rotated by a seeded
random rotation and cut to its signs. From the packed signs and three scalars the
inner product with any query is estimated together with a bound of its error: a query
is cut to four bits a component, and bits in common are counted. Queries and codes meet
in blocks of bounded size; in each block the vectors whose upper bound reaches the k-th
best score so far, at first that of the best estimates of the whole block, are reranked
with the original vectors, and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridtally.session import materialize

BITS = 256
EPSILON = 4.0
SEED = 7
# Bits of a component of a rotated query.
QUERY_BITS = 4
CODE_BLOCK = 8192
QUERY_BLOCK = 1024
_SLICE, _CHUNK = 128, 2048
# Of so many best estimates for each wanted neighbour the scores set the first level.
_FIRST = 4
# Pairs whose vectors are laid side by side at a time.
_PAIRS = 8192

INDEX = "vec_id long, dim int, code binary, norm double, align double, shift double, vector binary"


def rotation(bits: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return q * np.sign(np.diag(r))


def _bits(dim: int, bits: int) -> int:
    return max(bits, -(-dim // 8) * 8)


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not zero."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(doubles, lambda x: x != 0)


def build_index(
    vectors: DataFrame, center: dict[int, list[float]], bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """Codes and scalars (INDEX) of ``vec_id, vector``; ``center`` by dimension."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby(batch.vector.map(len)):
                width = _bits(dim, bits)
                turn = turns.setdefault(width, rotation(width, seed))
                x = np.array(rows.vector.tolist(), dtype=np.float64)
                c = np.asarray(center[dim])
                rest = x - c
                norm = np.linalg.norm(rest, axis=1)
                unit = rest / np.where(norm > 0, norm, 1.0)[:, None]
                turned = unit @ turn[:dim]
                signs = turned > 0
                align = np.abs(turned).sum(axis=1) / np.sqrt(width)
                yield pd.DataFrame({
                    "vec_id": rows.vec_id.to_numpy(),
                    "dim": dim,
                    "code": [row.tobytes() for row in np.packbits(signs, axis=1)],
                    "norm": norm,
                    "align": np.where(norm > 0, align, 1.0),
                    "shift": rest @ c,
                    "vector": [row.tobytes() for row in x],
                })

    return vectors.mapInPandas(encode, INDEX)


def _planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries in QUERY_BITS bits a component: packed bit planes, least value, step and sum of levels."""
    least = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - least, 1e-30) / (2**QUERY_BITS - 1)
    level = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
    planes = [np.packbits((level >> j) & 1, axis=1) for j in range(QUERY_BITS)]
    return np.stack(planes), least, step, level.sum(axis=1, dtype=np.int64)


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as 64-bit words; missing bits are zero."""
    short = -packed.shape[-1] % 8
    padded = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(padded).view(np.uint64)


def _common(planes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The sum of the levels of each query where each code has a bit set, counted in packed words."""
    found = np.empty((planes.shape[1], code.shape[1]), dtype=np.float32)
    rows = 32
    for low in range(0, len(found), rows):
        own = planes[:, low : low + rows]
        total = np.zeros((own.shape[1], code.shape[1]), dtype=np.uint32)
        both, bits = np.empty(total.shape, dtype=np.uint64), np.empty(total.shape, dtype=np.uint8)
        for plane in own[::-1]:
            total <<= 1
            for word in range(len(code)):
                np.bitwise_and(plane[:, word, None], code[word], out=both)
                total += np.bitwise_count(both, out=bits)
        found[low : low + rows] = total
    return found


def _products(x: np.ndarray, at: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Inner products of rows ``at`` of x and ``of`` of y, but for the order of additions."""
    out = np.empty(len(at))
    for low in range(0, len(at), _PAIRS):
        part = slice(low, low + _PAIRS)
        out[part] = np.einsum("ij,ij->i", x[at[part]], y[of[part]])
    return out


def _search_block(
    queries: pd.DataFrame, codes: pd.DataFrame, center: np.ndarray, k: int, bits: int, epsilon: float, seed: int
) -> pd.DataFrame:
    """The k best of one block of codes for each query of one block.

    Codes stay packed: their product with a query of few bits a component is a count of
    common bits per plane. What may beat the k-th best score so far is reranked.
    """
    dim = int(codes.dim.iloc[0])
    width = _bits(dim, bits)
    vectors = np.frombuffer(b"".join(codes.vector), dtype=np.float64).reshape(-1, dim)
    code = _words(np.frombuffer(b"".join(codes.code), dtype=np.uint8).reshape(len(codes), -1))
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.float32)
    code = np.ascontiguousarray(code.T)
    norm, align, shift = (codes[c].to_numpy() for c in ("norm", "align", "shift"))
    spread = (norm * np.sqrt(np.maximum(1 - align**2, 0)) / align * epsilon / np.sqrt(width - 1)).astype(np.float32)
    factor = (norm / (align * np.sqrt(width))).astype(np.float32)
    shift = shift.astype(np.float32)
    longest = np.linalg.norm(vectors, axis=1).max()
    ids = codes.vec_id.to_numpy()
    q_ids = queries.vec_id.to_numpy()
    q_vectors = np.frombuffer(b"".join(queries.vector), dtype=np.float64).reshape(-1, dim)
    turn = rotation(width, seed)[:dim]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(q_ids), _SLICE):
        own, own_ids = q_vectors[low : low + _SLICE], q_ids[low : low + _SLICE]
        rest = own - center
        planes, least, step, levels = _planes(rest @ turn)
        planes = _words(planes)
        offset = (-least * width - step * levels).astype(np.float32)[:, None]
        least, twice = (2 * least).astype(np.float32)[:, None], (2 * step).astype(np.float32)[:, None]
        plain = (own @ center).astype(np.float32)[:, None]
        # The error of a code grows with the query's length, that of the query with its step.
        length = np.linalg.norm(rest, axis=1).astype(np.float32)[:, None]
        rounding = (epsilon * step * np.sqrt(width / 12)).astype(np.float32)[:, None]
        # What rounding of numbers adds to estimates, and to sums in another order.
        size = np.maximum(np.linalg.norm(own, axis=1) * longest, 1)
        unsure, slack = (1e-5 * size).astype(np.float32)[:, None], 1e-9 * size
        estimate = np.empty((len(own), len(ids)), dtype=np.float32)
        for begin in range(0, len(ids), _CHUNK):
            at = slice(begin, begin + _CHUNK)
            common = _common(planes, code[:, at])
            estimate[:, at] = (twice * common + least * ones[at] + offset) * factor[at] + shift[at] + plain
        rows, columns, scores = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        level = np.full(len(own), -np.inf)
        if len(ids) > k:
            # The scores of the best estimates of the whole block give a first level.
            most = min(_FIRST * k, len(ids))
            first = np.argpartition(-estimate, most - 1, axis=1)[:, :most]
            near, place = np.repeat(np.arange(len(own)), most), first.ravel()
            sure = _products(vectors, place, own, near)
            sure[(ids[place] == own_ids[near]) | ~np.isfinite(sure)] = -np.inf
            level = -np.partition(-sure.reshape(len(own), most), k - 1, axis=1)[:, k - 1] - slack
        for begin in range(0, len(ids), _CHUNK):
            at = slice(begin, begin + _CHUNK)
            most = estimate[:, at] + (length * spread[at] + rounding * factor[at] + unsure)
            other = own_ids[:, None] != ids[at][None, :]
            near, place = np.nonzero(~(most < level[:, None].astype(np.float32)) & other)
            place += begin
            may = ~(_products(vectors, place, own, near) < level[near] - slack[near])
            near, place = near[may], place[may]
            exact = np.zeros(len(near))
            for d in range(dim):  # one order of additions, so equal vectors have equal scores
                exact += vectors[place, d] * own[near, d]
            rows = np.concatenate([rows, near])
            columns, scores = np.concatenate([columns, place]), np.concatenate([scores, exact])
            order = np.lexsort((ids[columns], -scores, rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, columns, scores = rows[best], columns[best], scores[best]
            # The score of the k-th best, of queries that have so many.
            last = np.flatnonzero(np.bincount(rows, minlength=len(own)) == k)
            level[last] = np.maximum(level[last], scores[np.searchsorted(rows, last) + k - 1] - slack[last])
        found.append((q_ids[low + rows], ids[columns], scores))
    query_id, vec_id, score = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    bits: int = BITS,
    epsilon: float = EPSILON,
    seed: int = SEED,
    code_block: int = CODE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by inner product.

    ``vectors`` has ``vec_id, embedding``; ``is_query`` picks the queries among them.
    Null or zero vectors, such with null or non-finite components and rows without an
    id take no part; a query meets only vectors of its dimension, and no row with its
    own id. Ties go to the smaller ``vec_id``; rows that repeat an id and vector are
    one. Every vector is indexed. A neighbour is missed only if its error exceeds
    ``epsilon`` standard deviations.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
        "vec_id", F.col("vector").cast("array<double>").alias("vector"), "is_query"
    )
    # One row per dimension, which all vectors of a table usually share.
    sums = rows.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("d", "x"))
    means = sums.groupBy("dim", "d").agg(F.avg("x").alias("x")).groupBy("dim").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("center")
    )
    center = {r.dim: list(r.center) for r in means.collect()}
    distinct = rows.select("vec_id", "vector").distinct()
    index = materialize(build_index(distinct, center, bits, seed), "vector_index")
    total = index.count()
    code_blocks = max(1, -(-total // code_block))
    asked = index.join(rows.where("is_query").select("vec_id").distinct(), "vec_id", "left_semi")
    asked = materialize(asked.select("vec_id", "dim", "vector"), "queries")
    query_blocks = max(1, -(-asked.count() // query_block))
    place = F.xxhash64("vec_id", "vector")
    left = asked.select("*", F.pmod(place, F.lit(query_blocks)).alias("qb")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(code_blocks - 1).cast("long")))
    )
    right = index.select("*", F.pmod(place, F.lit(code_blocks)).alias("cb")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))
    )

    def search(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or codes.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c = np.asarray(center[int(codes.dim.iloc[0])])
        return _search_block(queries, codes, c, k, bits, epsilon, seed)

    keys = ["dim", "cb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    # A query has k rows of each block at most.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
