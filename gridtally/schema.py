"""Column names, types and table names of readings and of all derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. CSV headers, table and column names, measure types, limits and
# the outlier tag are part of the data format that existing files, warehouse
# tables and user queries rely on.
# ---------------------------------------------------------------------------

# Header of a reading file: one row per reading.
READING_HEADER = ("LCLid", "day", "energy_kwh", "timestamp")
REQUIRED_COLUMNS = ("LCLid", "day", "energy_kwh")

# Header of a half-hour file: no day column, readings may be the word Null.
HALF_HOUR_HEADER = ("LCLid", "tstp", "energy(kWh/hh)")

# Natural key of a reading.
READING_KEY = ("lclid", "day", "timestamp")

ENERGY = T.DecimalType(10, 4)
# The same four decimals for values below 10,000 kWh. Spark sums decimals of up to
# eight digits as long integers and stores them in four bytes.
COMPACT_ENERGY = T.DecimalType(8, 4)
COMPACT_LIMIT = 9999.9999
# Totals are wider than the (12,4) of the original tables, which end at
# 100 million kWh: an hour of some 100 million households would not fit.
TOTAL = T.DecimalType(20, 4)

MAX_PLAUSIBLE_KWH = 100.0
ANOMALY_THRESHOLD = 3.0
ANOMALY_TYPE = "outlier"

RAW_TABLE = "raw.energy_consumption"
REJECTED_TABLE = "raw.rejected_readings"
ANALYTICS_TABLES = {
    "hourly": "analytics.hourly_consumption",
    "daily": "analytics.daily_consumption",
    "weekly": "analytics.weekly_consumption",
    "monthly": "analytics.monthly_consumption",
    "household_stats": "analytics.household_stats",
    "anomalies": "analytics.anomalies",
}

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# ---------------------------------------------------------------------------

READING = T.StructType(
    [
        T.StructField("lclid", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("energy_kwh", ENERGY),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

RAW = T.StructType(
    READING.fields
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("month", T.DateType()),
    ]
)


def _rollup(period: str, period_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(period, period_type),
            T.StructField("total_consumption", TOTAL),
            T.StructField("avg_consumption", ENERGY),
            T.StructField("max_consumption", ENERGY),
            T.StructField("min_consumption", ENERGY),
            T.StructField("household_count", T.IntegerType()),
        ]
    )


# Lines of files that were left out of the raw table.
REJECTED = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("fields", T.StringType()),
        T.StructField("copies", T.LongType()),
    ]
)


DATASETS: dict[str, T.StructType] = {
    "hourly": _rollup("hour", T.TimestampType()),
    "daily": _rollup("day", T.DateType()),
    "weekly": _rollup("week_start", T.DateType()),
    "monthly": _rollup("month", T.DateType()),
    "household_stats": T.StructType(
        [
            T.StructField("lclid", T.StringType()),
            T.StructField("total_consumption", TOTAL),
            T.StructField("avg_daily_consumption", ENERGY),
            T.StructField("max_daily_consumption", ENERGY),
            T.StructField("min_daily_consumption", ENERGY),
            T.StructField("days_count", T.IntegerType()),
        ]
    ),
    "anomalies": T.StructType(
        [
            T.StructField("lclid", T.StringType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("energy_kwh", ENERGY),
            T.StructField("z_score", ENERGY),
            T.StructField("anomaly_type", T.StringType()),
        ]
    ),
}

# Stored sums that rollups start from. Squares are summed with all their decimals.
_SUMS = [
    T.StructField("reading_count", T.LongType()),
    T.StructField("total_kwh", TOTAL),
    T.StructField("total_kwh_squared", T.DecimalType(28, 8)),
    T.StructField("max_kwh", ENERGY),
    T.StructField("min_kwh", ENERGY),
]
_HOUSEHOLD = [T.StructField("lclid", T.StringType()), T.StructField("day", T.DateType())]
HOUSEHOLD_DAY = T.StructType([*_HOUSEHOLD, *_SUMS])
HOUSEHOLD_DAY_STATE = T.StructType(
    [*_HOUSEHOLD, T.StructField("midnight", T.TimestampType()), *_SUMS, T.StructField("hours", T.LongType())]
)
HOUR_SUM = T.StructType(
    [T.StructField("hour", T.TimestampType()), *[f for f in _SUMS if f.name != "total_kwh_squared"]]
)
# Readings that may be outliers, and the bounds of all others of a household and month.
CANDIDATE = T.StructType(
    [
        T.StructField("lclid", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("energy_kwh", ENERGY),
    ]
)
REACH = T.StructType(
    [
        T.StructField("lclid", T.StringType()),
        T.StructField("in_month", T.DateType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)

# The columns that reports look rows up by; together unique in each dataset.
LOOKUP_KEYS = {
    "hourly": ("hour",),
    "daily": ("day",),
    "weekly": ("week_start",),
    "monthly": ("month",),
    "household_stats": ("lclid",),
    "anomalies": ("timestamp", "lclid"),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` by name and cast them to its types."""

    def typed(field: T.StructField) -> Column:
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return df.select(*[typed(field) for field in schema.fields])
