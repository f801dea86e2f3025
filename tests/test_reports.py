from gridtally.operators import reports, rollups
from gridtally.schema import DATASETS
from helpers import D, date, plan_of, readings, rows_of, time

ROWS = [
    ("A", "2024-01-01 00:10", 1),
    ("A", "2024-01-01 05:10", 3),
    ("B", "2024-01-02 05:10", 5),
    ("B", "2024-01-03 23:59", 7),
]


def daily(spark):
    return rollups.daily_rollup(rollups.household_days(readings(spark, *ROWS)))


def hourly(spark):
    return rollups.hourly_rollup(readings(spark, *ROWS))


def test_overview_sums_household_days(spark):
    result = reports.overview(daily(spark), date("2024-01-01"), date("2024-01-02")).collect()
    assert [tuple(row) for row in result] == [(2, D(9), D("3.5000"), D(5))]


def test_overview_of_an_empty_period_is_one_row_of_zeros(spark):
    result = reports.overview(daily(spark), date("2030-01-01"), date("2030-12-31")).collect()
    assert [tuple(row) for row in result] == [(0, D(0), D(0), D(0))]


def test_period_is_inclusive_and_optional(spark):
    assert reports.daily_series(daily(spark)).count() == 3
    assert reports.daily_series(daily(spark), date("2024-01-02")).count() == 2
    assert reports.daily_series(daily(spark), None, date("2024-01-02")).count() == 2
    hours = reports.hourly_series(hourly(spark), date("2024-01-03"), date("2024-01-03")).collect()
    assert [row["hour"] for row in hours] == [time("2024-01-03 23:00")]


def test_hourly_series_stops_at_the_limit(spark):
    hours = [row["hour"] for row in reports.hourly_series(hourly(spark), max_hours=2).collect()]
    assert hours == [time("2024-01-01 00:00"), time("2024-01-01 05:00")]
    assert reports.hourly_series(hourly(spark), max_hours=None).count() == 4
    profile = reports.hour_of_day_profile(hourly(spark), max_hours=2).collect()
    assert [tuple(row) for row in profile] == [(0, D(1)), (5, D(3))]


def test_hour_of_day_profile(spark):
    assert [tuple(row) for row in reports.hour_of_day_profile(hourly(spark)).collect()] == [
        (0, D(1)),
        (5, D(4)),
        (23, D(7)),
    ]


def test_heatmap_has_null_for_absent_hours(spark):
    grid = reports.day_hour_heatmap(hourly(spark)).collect()
    assert len(grid) == 3 and len(grid[0]) == 25
    assert (grid[0]["h00"], grid[0]["h05"], grid[0]["h23"]) == (D(1), D(3), None)


def test_weekday_profile_has_all_days(spark):
    result = [tuple(row) for row in reports.weekday_profile(daily(spark)).collect()]
    assert result[:3] == [(1, "Monday", D(2)), (2, "Tuesday", D(5)), (3, "Wednesday", D(7))]
    assert [row[1:] for row in result[3:]] == [
        ("Thursday", None), ("Friday", None), ("Saturday", None), ("Sunday", None)]


def stats(spark, *rows):
    typed = [(name, D(total), D(average), D(1), D(1), 1) for name, total, average in rows]
    return spark.createDataFrame(typed, DATASETS["household_stats"])


def test_top_households_break_ties_by_name(spark):
    table = stats(spark, ("B", 5, 1), ("A", 5, 1), ("C", 9, 1))
    top = reports.top_households(table, 2)
    assert [row["lclid"] for row in top.collect()] == ["C", "A"]
    assert "TakeOrderedAndProject" in plan_of(top)


def test_histogram(spark):
    table = stats(spark, *[(str(i), i, i) for i in range(41)])
    bins = [tuple(row) for row in reports.household_histogram(table, top_n=None).collect()]
    assert bins[0] == (1, D(0), D(2), 2) and bins[-1] == (20, D(38), D(40), 3)
    assert sum(row[3] for row in bins) == 41
    top = [tuple(row) for row in reports.household_histogram(table, bins=5, top_n=10).collect()]
    assert top[0][1] == D(31) and sum(row[3] for row in top) == 10


def test_histogram_of_one_value(spark):
    table = stats(spark, ("A", 5, 2), ("B", 6, 2))
    assert rows_of(reports.household_histogram(table)) == [(1, D(2), D("2.0000"), 2)]


def test_latest_days(spark):
    assert [row["day"] for row in reports.latest_days(daily(spark), 2).collect()] == [
        date("2024-01-03"), date("2024-01-02")]
