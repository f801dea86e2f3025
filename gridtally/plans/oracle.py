"""The registered queries in SQL, for DuckDB over the same tables.

Averages are computed in integers, half up: a double average rounds ties differently.
"""

from __future__ import annotations

# --- inputs -----------------------------------------------------------------

EVENTS = """
    SELECT CAST(user_id AS VARCHAR) AS lclid, CAST(ts AS DATE) AS day,
           CAST(value AS DECIMAL(10,4)) AS energy_kwh, ts AS "timestamp"
    FROM events"""

LINEITEM = """
    SELECT CAST(l_suppkey AS VARCHAR) AS lclid, CAST(l_shipdate AS DATE) AS day,
           CAST(l_quantity AS DECIMAL(10,4)) AS energy_kwh, l_shipdate AS "timestamp"
    FROM lineitem"""

DIRTY = """
    SELECT CASE WHEN minute(ts) <> 5 THEN CAST(user_id AS VARCHAR) END AS lclid,
           CASE WHEN minute(ts) <> 15 THEN CAST(ts AS DATE) END AS day,
           CASE WHEN minute(ts) = 25 THEN NULL
                WHEN minute(ts) IN (35, 36) THEN -CAST(value AS DECIMAL(10,4))
                ELSE CAST(value AS DECIMAL(10,4)) END AS energy_kwh,
           CASE WHEN minute(ts) <> 45 THEN date_trunc('hour', ts) END AS "timestamp"
    FROM events"""

READING = 'lclid, day, energy_kwh, "timestamp"'


def clean(readings: str, max_kwh: int = 100) -> str:
    return f"""
    SELECT {READING} FROM ({readings})
    WHERE lclid IS NOT NULL AND day IS NOT NULL AND "timestamp" IS NOT NULL
      AND energy_kwh >= 0 AND energy_kwh <= {max_kwh}"""


def distinct_keys(readings: str, max_kwh: int = 100) -> str:
    """Smallest plausible value per key, or smallest of all."""
    return f"""
    SELECT lclid, day,
           COALESCE(MIN(energy_kwh) FILTER (WHERE energy_kwh BETWEEN 0 AND {max_kwh}),
                    MIN(energy_kwh)) AS energy_kwh, "timestamp"
    FROM ({readings})
    WHERE lclid IS NOT NULL AND day IS NOT NULL AND energy_kwh IS NOT NULL
    GROUP BY lclid, day, "timestamp\""""


def exact_avg(total: str, count: str, digits: int = 10) -> str:
    """total / count, half up to four decimals."""
    units = f"CAST({total} * 10000 AS HUGEINT)"
    rounded = f"(({units} * 2 + {count}) // (2 * {count}))"
    return f"CAST(CAST({rounded} AS DECIMAL(24,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL({digits},4))"


def rollup(readings: str, key: str, name: str) -> str:
    return f"""
    SELECT {key} AS {name},
           CAST(SUM(energy_kwh) AS DECIMAL(20,4)) AS total_consumption,
           {exact_avg("SUM(energy_kwh)", "COUNT(*)")} AS avg_consumption,
           MAX(energy_kwh) AS max_consumption,
           MIN(energy_kwh) AS min_consumption,
           CAST(COUNT(DISTINCT lclid) AS INTEGER) AS household_count
    FROM ({readings}) GROUP BY 1"""


def stats(readings: str) -> str:
    return f"""
    SELECT lclid,
           CAST(SUM(energy_kwh) AS DECIMAL(20,4)) AS total_consumption,
           {exact_avg("SUM(energy_kwh)", "COUNT(*)")} AS avg_daily_consumption,
           MAX(energy_kwh) AS max_daily_consumption,
           MIN(energy_kwh) AS min_daily_consumption,
           CAST(COUNT(DISTINCT day) AS INTEGER) AS days_count
    FROM ({readings}) GROUP BY lclid"""


HOURLY = rollup(clean(EVENTS), "date_trunc('hour', \"timestamp\")", "hour")
DAILY = rollup(clean(EVENTS), "day", "day")
STATS = stats(clean(LINEITEM))

PERIOD = "BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"
MEASURES = "total_consumption, avg_consumption, max_consumption, min_consumption"

TRUE_DAILY = f"""
    SELECT lclid,
           CAST(SUM(total) AS DECIMAL(20,4)) AS total_consumption,
           {exact_avg("SUM(total)", "COUNT(*)", 20)} AS avg_daily_consumption,
           CAST(MAX(total) AS DECIMAL(20,4)) AS max_daily_consumption,
           CAST(MIN(total) AS DECIMAL(20,4)) AS min_daily_consumption,
           CAST(COUNT(*) AS INTEGER) AS days_count
    FROM (SELECT lclid, day, CAST(SUM(energy_kwh) AS DECIMAL(20,4)) AS total
          FROM ({clean(EVENTS)}) GROUP BY lclid, day)
    GROUP BY lclid"""

BASELINE = f"""
    SELECT lclid, COUNT(*) AS reading_count,
           {exact_avg("SUM(energy_kwh)", "COUNT(*)")} AS mean_consumption,
           CAST(ROUND(STDDEV_SAMP(CAST(energy_kwh AS DOUBLE)), 4) AS DECIMAL(10,4)) AS stddev_consumption
    FROM ({clean(EVENTS, 1000)}) GROUP BY lclid"""



def outliers(readings: str) -> str:
    return f"""
    SELECT lclid, "timestamp", energy_kwh,
           CAST(ROUND(z, 4) AS DECIMAL(10,4)) AS z_score, 'outlier' AS anomaly_type
    FROM (SELECT r.*, CASE WHEN s.stddev > 0
                           THEN abs(CAST(r.energy_kwh AS DOUBLE) - s.mean) / s.stddev
                           ELSE 0 END AS z
          FROM ({readings}) r
          JOIN (SELECT lclid, AVG(CAST(energy_kwh AS DOUBLE)) AS mean,
                       STDDEV_SAMP(CAST(energy_kwh AS DOUBLE)) AS stddev
                FROM ({readings}) GROUP BY lclid) s USING (lclid))
    WHERE z > 3"""


ANOMALIES = outliers(clean(EVENTS, 1000))
# What a full run stores: de-duplicated, then cleaned.
STORED = clean(distinct_keys(EVENTS))
STORED_WIDE = clean(distinct_keys(EVENTS, 1000), 1000)

STORED_YEARS = clean(distinct_keys(LINEITEM))

HOURLY_SERIES = f"""
    SELECT hour, {MEASURES} FROM ({HOURLY})
    WHERE CAST(hour AS DATE) {PERIOD} ORDER BY hour"""

YEARS = rollup(clean(LINEITEM), "date_trunc('hour', \"timestamp\")", "hour")

MEAN_OF_AVERAGES = exact_avg("SUM(avg_consumption)", "COUNT(*)")

HEATMAP_COLUMNS = ",\n           ".join(
    f"MAX(avg_consumption) FILTER (WHERE hour(hour) = {h}) AS h{h:02d}" for h in range(24)
)


def histogram(chosen: str) -> str:
    units = "CAST(({}) * 10000 AS HUGEINT)"
    value, width = units.format("avg_daily_consumption - low"), units.format("high - low")

    def edge(number: str) -> str:
        total = f"(low * 20 + (high - low) * ({number}))"
        return exact_avg(total, "20")

    return f"""
    SELECT bin, {edge("bin - 1")} AS bin_start, {edge("bin")} AS bin_end, household_count
    FROM (SELECT CAST(LEAST(CASE WHEN high > low THEN {value} * 20 // {width} ELSE 0 END + 1, 20)
                      AS INTEGER) AS bin, low, high, COUNT(*) AS household_count
          FROM ({chosen}) c,
               (SELECT MIN(avg_daily_consumption) AS low, MAX(avg_daily_consumption) AS high
                FROM ({chosen})) b
          GROUP BY ALL)"""


TEN_DAYS = "BETWEEN DATE '2024-01-06' AND DATE '2024-01-15'"
THREE_DAYS = "BETWEEN DATE '2024-01-09' AND DATE '2024-01-11'"
NO_DAYS = "BETWEEN DATE '2023-01-01' AND DATE '2023-12-31'"


def overview(period: str) -> str:
    return f"""
            SELECT CAST(COALESCE(SUM(household_count), 0) AS BIGINT) AS total_households,
                   CAST(COALESCE(SUM(total_consumption), 0) AS DECIMAL(20,4)) AS total_energy,
                   CAST(COALESCE({MEAN_OF_AVERAGES}, 0) AS DECIMAL(10,4)) AS avg_consumption,
                   CAST(COALESCE(MAX(max_consumption), 0) AS DECIMAL(10,4)) AS peak_consumption
            FROM ({DAILY}) WHERE day {period}"""


def weekday_profile(period: str) -> str:
    return f"""
            SELECT w.number AS weekday_number, w.name AS day_of_week, m.avg_consumption
            FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'),
                         (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) w(number, name)
            LEFT JOIN (SELECT isodow(day) AS number, {MEAN_OF_AVERAGES} AS avg_consumption
                       FROM ({DAILY}) WHERE day {period} GROUP BY 1) m USING (number)
            ORDER BY 1"""


TOP50 = f"SELECT * FROM ({STATS}) ORDER BY total_consumption DESC, lclid LIMIT 50"

HOURS = """
    SELECT CAST(user_id AS VARCHAR) AS lclid, CAST(ts AS DATE) AS day,
           CAST(value AS DECIMAL(10,4)) AS energy_kwh, date_trunc('hour', ts) AS "timestamp"
    FROM events"""

APPENDED = f"""
    WITH first AS ({distinct_keys(DIRTY)}), second AS ({distinct_keys(HOURS)})
    SELECT {READING} FROM first
    UNION ALL
    SELECT {READING} FROM second s WHERE NOT EXISTS (
        SELECT 1 FROM first f WHERE f.lclid = s.lclid AND f.day = s.day
        AND f."timestamp" IS NOT DISTINCT FROM s."timestamp")"""

# In the half-hour layout the day comes from the timestamp.
HALF_HOURS = f"""
    SELECT lclid, CAST("timestamp" AS DATE) AS day, energy_kwh, "timestamp" FROM ({DIRTY})"""


# Two runs: of the readings up to a day within the years, then of all. A run reads the
# months that hold readings of its delivery; without outliers nothing else is read.
FIRST_YEARS = f"SELECT * FROM ({LINEITEM}) WHERE day <= DATE '1996-06-15'"
FIRST_STORED, FIRST_CLEAN = distinct_keys(FIRST_YEARS), clean(distinct_keys(FIRST_YEARS))


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_profile": f"""
            SELECT COUNT(*) AS reading_count,
                   COUNT(*) FILTER (WHERE energy_kwh >= 0 AND energy_kwh <= 100) AS clean_count,
                   CAST(COUNT(DISTINCT lclid) AS INTEGER) AS household_count
            FROM ({EVENTS})""",
        "households": f"SELECT DISTINCT lclid FROM ({EVENTS})",
        "clean_readings": distinct_keys(clean(DIRTY)),
        "ingested_readings": distinct_keys(DIRTY),
        "deduplicated_readings": distinct_keys(LINEITEM),
        "hourly_rollup": HOURLY,
        "daily_rollup": DAILY,
        "weekly_rollup": rollup(clean(LINEITEM), "CAST(date_trunc('week', day) AS DATE)", "week_start"),
        "monthly_rollup": rollup(clean(LINEITEM), "CAST(date_trunc('month', day) AS DATE)", "month"),
        "household_stats": STATS,
        "household_true_daily": TRUE_DAILY,
        "household_baseline": BASELINE,
        "anomalies": ANOMALIES,
        "anomalies_shuffled": ANOMALIES,
        "anomaly_series": f"""
            SELECT * FROM ({ANOMALIES}) WHERE CAST("timestamp" AS DATE) {PERIOD}
            ORDER BY "timestamp", lclid""",
        "anomaly_top_households": f"""
            SELECT lclid, COUNT(*) AS anomaly_count FROM ({ANOMALIES})
            GROUP BY lclid ORDER BY anomaly_count DESC, lclid LIMIT 10""",
        "overview": overview(PERIOD),
        "daily_series": f"""
            SELECT day, {MEASURES}, household_count FROM ({DAILY})
            WHERE day {PERIOD} ORDER BY day""",
        "hourly_series": HOURLY_SERIES,
        "hour_of_day_profile": f"""
            SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, {MEAN_OF_AVERAGES} AS avg_consumption
            FROM ({HOURLY_SERIES}) GROUP BY 1 ORDER BY 1""",
        "day_hour_heatmap": f"""
            SELECT CAST(hour AS DATE) AS day, {HEATMAP_COLUMNS}
            FROM ({HOURLY_SERIES}) GROUP BY 1 ORDER BY 1""",
        "weekday_profile": weekday_profile(PERIOD),
        "overview_period": overview(TEN_DAYS),
        "overview_empty_range": overview(NO_DAYS),
        "weekday_profile_period": weekday_profile(THREE_DAYS),
        "hourly_series_period": f"""
            SELECT hour, {MEASURES} FROM ({HOURLY}) WHERE CAST(hour AS DATE) {TEN_DAYS} ORDER BY hour""",
        "hourly_series_first_100": f"{HOURLY_SERIES} LIMIT 100",
        "hourly_series_years": f"SELECT hour, {MEASURES} FROM ({YEARS}) ORDER BY hour",
        "hour_of_day_profile_years": f"""
            SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, {MEAN_OF_AVERAGES} AS avg_consumption
            FROM ({YEARS}) GROUP BY 1 ORDER BY 1""",
        "day_hour_heatmap_years": f"""
            SELECT CAST(hour AS DATE) AS day, {HEATMAP_COLUMNS}
            FROM ({YEARS}) GROUP BY 1 ORDER BY 1""",
        "latest_days": f"SELECT * FROM ({DAILY}) ORDER BY day DESC LIMIT 10",
        "top_households": TOP50,
        "top10_households": f"SELECT * FROM ({TOP50}) ORDER BY total_consumption DESC, lclid LIMIT 10",
        "household_histogram": histogram(STATS),
        "household_histogram_top50": histogram(TOP50),
        "household_histogram_all": histogram(STATS),
        "csv_ingest": distinct_keys(EVENTS),
        "csv_ingest_half_hour": distinct_keys(HALF_HOURS),
        "csv_mixed_folder": distinct_keys(EVENTS),
        "rejected_readings": f"""
            SELECT CONCAT_WS(',', CASE WHEN lclid IS NULL THEN 'lclid' END, CASE WHEN day IS NULL THEN 'day' END,
                             CASE WHEN energy_kwh IS NULL THEN 'energy_kwh' END) AS reason,
                   {READING}, COUNT(*) AS copies
            FROM ({DIRTY}) WHERE lclid IS NULL OR day IS NULL OR energy_kwh IS NULL GROUP BY ALL""",
        "pipeline_counts": f"""
            SELECT COUNT(*) AS read_count, COUNT(*) FILTER (WHERE known) AS identified_count,
                   COUNT(*) FILTER (WHERE known AND energy_kwh BETWEEN 0 AND 100) AS plausible_count,
                   (SELECT COUNT(*) FROM ({distinct_keys(DIRTY)})) AS added_count
            FROM (SELECT energy_kwh, lclid IS NOT NULL AND day IS NOT NULL AND energy_kwh IS NOT NULL AS known
                  FROM ({DIRTY}))""",
        "idempotent_append": APPENDED,
        "incremental_ingest": distinct_keys(EVENTS),
        "parquet_reload": DAILY,
        "pipeline_daily": rollup(STORED, "day", "day"),
        "pipeline_hourly": rollup(STORED, "date_trunc('hour', \"timestamp\")", "hour"),
        "pipeline_household_stats": stats(STORED),
        "pipeline_weekly": rollup(STORED_YEARS, "CAST(date_trunc('week', day) AS DATE)", "week_start"),
        "pipeline_monthly": rollup(STORED_YEARS, "CAST(date_trunc('month', day) AS DATE)", "month"),
        "pipeline_anomalies": outliers(STORED_WIDE),
        "incremental_hourly": rollup(STORED, "date_trunc('hour', \"timestamp\")", "hour"),
        "incremental_weekly": rollup(STORED_YEARS, "CAST(date_trunc('week', day) AS DATE)", "week_start"),
        "incremental_household_stats": stats(STORED_YEARS),
        "incremental_anomalies": outliers(STORED_WIDE),
        "incremental_counts": f"""
            WITH runs(run, added, clean, households, months_read) AS (
                SELECT 1, (SELECT COUNT(*) FROM ({FIRST_STORED})), COUNT(*), COUNT(DISTINCT lclid),
                       COUNT(DISTINCT date_trunc('month', day)) FROM ({FIRST_CLEAN})
                UNION ALL
                SELECT 2, (SELECT COUNT(*) FROM ({distinct_keys(LINEITEM)})) - (SELECT COUNT(*) FROM ({FIRST_STORED})),
                       COUNT(*), COUNT(DISTINCT lclid),
                       COUNT(DISTINCT date_trunc('month', day)) FILTER (WHERE day >= DATE '1996-06-01')
                FROM ({STORED_YEARS})
            )
            SELECT CAST(run AS BIGINT) AS run, added, clean, households, months_read,
                   (SELECT COUNT(*) FROM ({outliers(FIRST_CLEAN)})) * (2 - run)
                   + (SELECT COUNT(*) FROM ({outliers(STORED_YEARS)})) * (run - 1) AS anomalies
            FROM runs""",
        "adhoc_sql": f"""
            SELECT lclid, total_consumption, days_count,
                   (SELECT COUNT(*) FROM ({distinct_keys(LINEITEM)})) AS raw_rows
            FROM ({stats(clean(distinct_keys(LINEITEM)))})
            ORDER BY total_consumption DESC, lclid LIMIT 10""",
    }
