"""Small inputs written by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridtally.schema import READING


def readings(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows of (household, 'yyyy-mm-dd HH:MM', kWh); the day is that of the timestamp."""
    typed = []
    for household, time, kwh in rows:
        stamp = dt.datetime.fromisoformat(time)
        typed.append((household, stamp.date(), Decimal(str(kwh)), stamp))
    return spark.createDataFrame(typed, READING)


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)


def write_file(folder: Path, name: str, *lines: str) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


D = Decimal
