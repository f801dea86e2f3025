from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from gridtally.operators import rollups
from helpers import D, date, readings, rows_of, time

SAMPLE = [
    ("A", "2024-01-01 00:00", "0.1000"),
    ("A", "2024-01-01 00:30", "0.2000"),
    ("B", "2024-01-01 00:15", "0.3001"),
    ("A", "2024-01-07 23:30", "1.0000"),
    ("B", "2024-02-01 05:00", "2.0000"),
]


def test_hourly(spark):
    assert rows_of(rollups.hourly_rollup(readings(spark, *SAMPLE))) == sorted(
        [
            (time("2024-01-01 00:00"), D("0.6001"), D("0.2000"), D("0.3001"), D("0.1000"), 2),
            (time("2024-01-07 23:00"), D("1.0000"), D("1.0000"), D("1.0000"), D("1.0000"), 1),
            (time("2024-02-01 05:00"), D("2.0000"), D("2.0000"), D("2.0000"), D("2.0000"), 1),
        ],
        key=repr,
    )


def test_weeks_start_on_monday_and_months_on_the_first(spark):
    days = rollups.household_days(readings(spark, *SAMPLE))
    weeks = {row["week_start"]: row for row in rollups.weekly_rollup(days).collect()}
    assert sorted(weeks) == [date("2024-01-01"), date("2024-01-29")]
    assert weeks[date("2024-01-01")]["total_consumption"] == D("1.6001")
    assert weeks[date("2024-01-01")]["household_count"] == 2
    months = {row["month"]: row for row in rollups.monthly_rollup(days).collect()}
    assert sorted(months) == [date("2024-01-01"), date("2024-02-01")]
    assert months[date("2024-01-01")]["avg_consumption"] == D("0.4000")


def test_day_rollup_groups_by_day_not_by_timestamp(spark):
    moved = readings(spark, *SAMPLE).selectExpr("lclid", "date '2024-03-03' AS day", "energy_kwh", "timestamp")
    daily = rollups.daily_rollup(rollups.household_days(moved)).collect()
    assert [row["day"] for row in daily] == [date("2024-03-03")]


def test_household_stats_are_per_reading_and_true_daily_per_day(spark):
    days = rollups.household_days(readings(spark, *SAMPLE))
    stats = {row[0]: tuple(row)[1:] for row in rollups.household_stats(days).collect()}
    assert stats["A"] == (D("1.3000"), D("0.4333"), D("1.0000"), D("0.1000"), 2)
    daily = {row[0]: tuple(row)[1:] for row in rollups.household_true_daily(days).collect()}
    assert daily["A"] == (D("1.3000"), D("0.6500"), D("1.0000"), D("0.3000"), 2)


def test_averages_round_half_up_once(spark):
    # 0.0003 / 2 = 0.00015 and 2148.37 / 56 = 38.36375 are ties.
    days = rollups.household_days(
        readings(spark, ("A", "2024-01-01 00:00", "0.0001"), ("A", "2024-01-01 01:00", "0.0002"))
    )
    assert rollups.household_stats(days).first()["avg_daily_consumption"] == D("0.0002")
    many = [("A", f"2024-01-0{1 + i // 24} {i % 24:02d}:00", "38.00" if i else "58.37") for i in range(56)]
    days = rollups.household_days(readings(spark, *many))
    assert rollups.household_stats(days).first()["avg_daily_consumption"] == D("38.3638")


def test_large_totals_fit(spark):
    # A hundred million kWh in one day are beyond twelve digits.
    rows = spark.range(1_000_001).selectExpr(
        "CAST(id AS STRING) AS lclid", "date '2024-01-01' AS day",
        "CAST(100 AS DECIMAL(8,4)) AS energy_kwh", "timestamp '2024-01-01 00:00:00' AS timestamp",
    )
    daily = rollups.daily_rollup(rollups.household_days(rows)).first()
    assert daily["total_consumption"] == D("100000100.0000")
    assert daily["household_count"] == 1_000_001


samples = st.lists(
    st.tuples(
        st.sampled_from(["A", "B", "C"]),
        st.datetimes(min_value=time("2023-12-20 00:00"), max_value=time("2024-03-10 00:00")).map(
            lambda t: t.isoformat(sep=" ")
        ),
        st.integers(0, 1_000_000).map(lambda v: D(v) / 10000),
    ),
    min_size=1,
    max_size=40,
)


@settings(max_examples=10, deadline=None)
@given(samples)
def test_totals_agree_at_every_grain(spark, sample):
    rows = readings(spark, *sample).repartition(4)
    days = rollups.household_days(rows)
    tables = [
        rollups.hourly_rollup(rows),
        rollups.daily_rollup(days),
        rollups.weekly_rollup(days),
        rollups.monthly_rollup(days),
        rollups.household_stats(days),
        rollups.household_true_daily(days),
    ]
    expected = sum(kwh for _, _, kwh in sample)
    for table in tables:
        result = table.collect()
        assert sum(row["total_consumption"] for row in result) == expected
        for row in result:
            average, largest, smallest = row[2], row[3], row[4]
            assert smallest <= average <= largest
    by_day = defaultdict(set)
    for household, stamp, _ in sample:
        by_day[time(stamp).date()].add(household)
    counted = {row["day"]: row["household_count"] for row in tables[1].collect()}
    assert counted == {day: len(names) for day, names in by_day.items()}
    by_hour = defaultdict(set)
    for household, stamp, _ in sample:
        by_hour[time(stamp).replace(minute=0, second=0, microsecond=0)].add(household)
    counted = {row["hour"]: row["household_count"] for row in tables[0].collect()}
    assert counted == {hour: len(names) for hour, names in by_hour.items()}


def test_the_day_the_clocks_are_set_back(spark):
    # 00:30, 01:30, 01:45 and 23:30 UTC; in London the first two are both 01:30.
    seconds = [1729989000, 1729992600, 1729993500, 1730071800]
    rows = spark.createDataFrame([(str(i), s) for i, s in enumerate(seconds)], "lclid string, s long").selectExpr(
        "lclid", "date '2024-10-27' AS day", "CAST(1 AS DECIMAL(8,4)) AS energy_kwh", "timestamp_seconds(s) AS timestamp"
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        hours = rollups.hourly_rollup(rows).selectExpr("unix_seconds(hour) AS s", "household_count").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(tuple(row) for row in hours) == [(1729987200, 1), (1729990800, 2), (1730070000, 1)]
