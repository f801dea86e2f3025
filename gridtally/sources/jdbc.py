"""Readings and datasets in a database behind JDBC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtally.schema import ANALYTICS_TABLES, DATASETS, RAW_TABLE, READING, conform


def read_options(
    url: str,
    start: dt.datetime,
    end: dt.datetime,
    partitions: int,
    table: str = RAW_TABLE,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options that split the scan by timestamp.

    The bounds only place the cuts: rows outside them, or without a timestamp, go to
    the first or last partition. Timestamps spread evenly where households or days
    may not.
    """
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "timestamp",
        "lowerBound": start.isoformat(sep=" "),
        "upperBound": end.isoformat(sep=" "),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def write_options(url: str, table: str, connections: int = 16, batch_size: int = 10_000) -> dict[str, str]:
    """Options that empty the table instead of dropping it, and bound the connections."""
    return {
        "url": url,
        "dbtable": table,
        "truncate": "true",
        "batchsize": str(batch_size),
        "numPartitions": str(connections),
    }


def read_jdbc_readings(
    spark: SparkSession, url: str, start: dt.datetime, end: dt.datetime, partitions: int, **properties: str
) -> DataFrame:
    """Readings of the raw table in a database, read over several connections."""
    options = {**read_options(url, start, end, partitions), **properties}
    return conform(spark.read.format("jdbc").options(**options).load(), READING)


def write_jdbc_dataset(df: DataFrame, name: str, url: str, **properties: str) -> None:
    """Replace the rows of the warehouse table of a dataset, from the executors."""
    options = {**write_options(url, ANALYTICS_TABLES[name]), **properties}
    rows = conform(df, DATASETS[name]).withColumn("created_at", F.current_timestamp())
    rows.write.format("jdbc").options(**options).mode("overwrite").save()


def append_jdbc_readings(readings: DataFrame, url: str, **properties: str) -> None:
    """Add readings to the raw table, from the executors; see ``new_readings``."""
    options = {**write_options(url, RAW_TABLE), **properties}
    conform(readings, READING).write.format("jdbc").options(**options).mode("append").save()
