"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights, and each document is
emitted floor(rate) times plus one further time with the fraction as probability,
drawn from a hash of the seed, its id and its text. Only the small table of sources is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtally.llm.common import SPACED_WORD, numbered, word_count
from gridtally.session import materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_REPEATS = 2
SEED = "mix"
_DIGITS = 13


def text_key(text: Column) -> Column:
    """What tells texts apart in a draw; null is as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def chance(seed: str, doc_id: Column, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of ``seed:doc_id:key``."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), key)
    bits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10)
    return bits.cast("double") / F.lit(float(16**_DIGITS))


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """``source, source_size, weight, target, rate`` from rows of ``source, size``.

    Sources in order of code points, null last, get the weights in turn. ``budget``
    times all sizes are shared by weight; a target stops at ``most_repeats`` times its
    source's size and the excess is reshared until none is above. Sources of size 0
    have target and rate 0. Weights must be positive.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(per_source, F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")
    )
    cap = F.col("source_size") * most_repeats
    table = materialize(
        ranked.withColumn("weight", weight).withColumn("cap", cap).drop("position"), "sources"
    )
    total, shares = table.agg(F.sum("source_size"), F.sum("weight")).first()
    words = Fraction(min(budget, most_repeats)) * (total or 0)
    # The level rises with every reshare, so no source leaves the capped ones again.
    level, filled = float(words / shares) if shares else 0.0, -1
    while True:
        open_ = F.col("cap") / F.col("weight") >= F.lit(level)
        capped, spent, left = table.agg(
            F.count_if(~open_), F.sum(F.when(~open_, F.col("cap"))), F.sum(F.when(open_, F.col("weight")))
        ).first()
        if capped == filled or not left:
            break
        level, filled = float((words - (spent or 0)) / left), capped
    target = F.when(F.col("cap") / F.col("weight") >= F.lit(level), F.lit(level) * F.col("weight"))
    target = F.least(F.coalesce(target, F.col("cap").cast("double")), F.col("cap").cast("double"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, doc_id: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + (chance(seed, doc_id, key) < rate - whole).cast("long")).cast("long")


def with_copies(
    docs: DataFrame,
    targets: DataFrame,
    seed: str = SEED,
    size: Column | None = None,
    key: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` and ``key`` (of the draw) are computed from ``text`` unless given; columns of
    ``docs`` with the four names are replaced. Null sources match the null source. Rows
    without an id draw by their texts; rows that share id and text share a draw.
    """
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    size = word_count(F.col("text"), SPACED_WORD) if size is None else size
    key = text_key(F.col("text")) if key is None else key
    left = docs.select(F.struct(*columns).alias("row"), size.alias("size"), key.alias("key"))
    right = targets.select(F.struct("*").alias("of"))
    joined = left.join(right, F.col("row.source").eqNullSafe(F.col("of.source")))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        "size",
        "of.source_size",
        "of.target",
        copies(F.col("of.rate"), F.col("row.doc_id"), F.col("key"), seed).alias("copies"),
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, seed: str = SEED
) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, numbered by ``copy``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``. A null text has size 0; such
    rows and empty texts are taken like all others of their source. An extra column
    ``copy`` is replaced, other extra columns are kept. No rows give no rows.
    """
    columns = [c for c in docs.columns if c != "copy"]
    sizes = docs.select("source", word_count(F.col("text"), SPACED_WORD).alias("size"))
    targets = source_targets(sizes, weights, budget)
    rows = docs.select(F.struct(*columns).alias("row")).select(
        "row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id")
    )
    key = text_key(F.col("row.text"))
    taken = with_copies(rows, targets, seed, size=F.lit(0), key=key).where(F.col("copies") > 0)
    numbers = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select("row", numbers.alias("copy")).select(
        *[F.col("row").getField(c).alias(c) for c in columns], "copy"
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = word_count(F.col("text"), SPACED_WORD).alias("size")
    sizes = materialize(docs.select("doc_id", "source", size, text_key(F.col("text")).alias("key")), "sizes")
    mixed = with_copies(sizes, source_targets(sizes), size=F.col("size"), key=F.col("key"))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


OP1_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS key,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
    SELECT source, source_size, 2 * source_size AS cap,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM per
), filled AS (
    SELECT *, cap / weight AS ratio,
           (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighted
), water AS (
    SELECT arg_min(level, ratio) FILTER (level <= ratio) AS level FROM filled
), targets AS (
    SELECT source, source_size, least(water.level * weight, cap::DOUBLE) AS target
    FROM filled, water
), rated AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), taken AS (
    SELECT s.doc_id, s.source, s.size, r.source_size, r.target,
           CAST(floor(rate) AS BIGINT) + CAST(
             CAST('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.key), 1, 13) AS BIGINT)
             / 4503599627370496.0::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
    FROM sizes s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM taken
"""
