"""Join readings with a table of one row per household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_BROADCAST_BYTES = 128 * 1024 * 1024
# What a household row takes in memory beside its name: numbers and a place in the table.
ROW_BYTES = 100
# The filter of wanted households: bits for each of them, and 16 MB of bits at most.
BITS_EACH = 8
MAX_FILTER_BITS = 1 << 27
_WORD = 64
# Share of all readings from which a household is spread over several join keys.
HOT_SHARE = 0.001


def join_households(
    readings: DataFrame,
    stats: DataFrame,
    wanted: Column,
    columns: list[str],
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Readings of the ``wanted`` households, with ``columns`` of their ``stats``.

    ``stats`` is a stored table with ``lclid`` and ``reading_count``. The bytes of its
    wanted rows are summed first, names included. Up to ``max_broadcast_bytes`` they are
    broadcast and the readings stay where they are. Beyond that most readings of other
    households are filtered out, both sides are shuffled, and readings of hot households
    are spread: a household with more than ``hot_share`` of all readings gets one join
    key per such share, so no key holds more. The list of hot households is broadcast;
    it has at most ``1 / hot_share`` rows.
    """
    row_bytes = F.octet_length("lclid") + ROW_BYTES
    size = stats.agg(
        F.count_if(wanted).alias("wanted"),
        F.coalesce(F.sum(F.when(wanted, row_bytes)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("reading_count"), F.lit(0)).alias("readings"),
    ).first()
    chosen = stats.where(wanted).select("lclid", "reading_count", *columns)
    if size["bytes"] <= max_broadcast_bytes:
        return readings.join(F.broadcast(chosen.drop("reading_count")), "lclid")

    readings_per_key = max(int(size["readings"] * hot_share), 1)
    keys = F.ceil(F.col("reading_count") / readings_per_key).cast("int")
    hot = stats.where(keys > 1).select("lclid", keys.alias("keys"), wanted.alias("wanted"))
    # Unwanted hot households leave here, before the shuffle.
    spread = (
        perhaps_wanted(readings, chosen, size["wanted"])
        .join(F.broadcast(hot), "lclid", "left")
        .where(F.coalesce("wanted", F.lit(True)))
        .withColumn("part", F.coalesce(_part(readings, F.col("keys")), F.lit(0)))
        .drop("keys", "wanted")
    )
    repeated = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), keys - 1)))
    # Without the hint Spark might still broadcast by its own estimate.
    few = repeated.drop("reading_count").hint("merge")
    return spread.join(few, ["lclid", "part"]).drop("part")


def perhaps_wanted(readings: DataFrame, chosen: DataFrame, households: int) -> DataFrame:
    """Readings of the ``chosen`` households, of which there are so many, and of few others.

    A household has one bit by the hash of its name. The words of bits that are set are
    broadcast: MAX_FILTER_BITS / 64 rows of two numbers at most. With BITS_EACH bits per
    chosen household an eighth of the others stay.
    """
    bits = min(max(households * BITS_EACH, _WORD), MAX_FILTER_BITS)
    place = F.pmod(F.xxhash64("lclid"), F.lit(bits))
    word, bit = F.floor(place / _WORD).alias("word"), (place % _WORD).cast("int")
    # The bit is a column, which the Python function takes as a number only.
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("flag")
    words = chosen.select(word, flag).groupBy("word").agg(F.bit_or("flag").alias("flags"))
    columns = readings.columns
    marked = readings.withColumn("word", word).join(F.broadcast(words), "word")
    return marked.where(F.getbit("flags", bit) == 1).select(*columns)


def _part(readings: DataFrame, parts: Column) -> Column:
    """A number below ``parts`` that depends on the row only, so retries repeat it."""
    return F.pmod(F.xxhash64(*readings.columns), parts.cast("bigint")).cast("int")
