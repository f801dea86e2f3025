"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridtally.session import materialize, new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Runs of anything but these are words: white space, or all ASCII but letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and no other letter."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column, word: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(word)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, stored, and its folder, for tables that are forgotten before the job ends."""
    folder = new_folder(df.sparkSession, name)
    return materialize(df, name, folder), folder


def forget(df: DataFrame, folder: str) -> None:
    """Remove a stored table that only stored tables were made from."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``df`` with the position of each row in ``order``, from 0, and no task over all rows.

    Rows are sorted by range and stored; the driver learns the rows of each partition.
    """
    place = F.monotonically_increasing_id()
    ordered = materialize(df.orderBy(*order).withColumn("_place", place), "numbered")
    part, offset = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for number in sorted(counts):
        starts.append((number, before))
        before += counts[number]
    spark = df.sparkSession
    # A row for each partition of the sort.
    first = spark.createDataFrame(starts, "_part long, _first long")
    joined = ordered.withColumn("_part", part).join(F.broadcast(first), "_part")
    return joined.withColumn(name, F.col("_first") + offset).drop("_place", "_part", "_first")
