from hypothesis import given, settings
from hypothesis import strategies as st

from gridtally.operators.cleaning import clean_readings, deduplicate, households, run_profile
from gridtally.schema import READING
from helpers import D, date, readings, rows_of, time

DAY, STAMP = date("2024-01-01"), time("2024-01-01 00:00")


def test_bounds_are_inclusive(spark):
    raw = readings(spark, *[("A", f"2024-01-01 0{i}:00", v) for i, v in enumerate(["-0.0001", 0, 100, "100.0001"])])
    assert sorted(row["energy_kwh"] for row in clean_readings(raw).collect()) == [D(0), D(100)]
    assert clean_readings(raw, max_kwh=200.0).count() == 3


def test_incomplete_readings_go(spark):
    whole = ("A", DAY, D(1), STAMP)
    rows = [whole] + [tuple(None if i == j else v for j, v in enumerate(whole)) for i in range(4)]
    assert clean_readings(spark.createDataFrame(rows, READING)).count() == 1


def test_survivor_is_the_smallest_plausible_value(spark):
    raw = readings(
        spark,
        *[("A", "2024-01-01 00:00", v) for v in (5, -1, 3, 200)],
        *[("B", "2024-01-01 00:00", v) for v in (300, 200)],
    )
    assert {(r["lclid"], r["energy_kwh"]) for r in deduplicate(raw).collect()} == {("A", D(3)), ("B", D(200))}


def test_missing_timestamps_are_equal(spark):
    raw = spark.createDataFrame([("A", DAY, D(2), None), ("A", DAY, D(1), None), ("A", DAY, D(3), STAMP)], READING)
    assert rows_of(deduplicate(raw)) == [("A", DAY, D(1), None), ("A", DAY, D(3), STAMP)]


values = st.one_of(st.none(), st.integers(-5, 130).map(lambda v: D(v)))
raw_rows = st.lists(
    st.tuples(
        st.sampled_from(["A", "B", None]),
        st.sampled_from([DAY, None]),
        values,
        st.sampled_from([STAMP, time("2024-01-01 01:00"), None]),
    ),
    min_size=1,
    max_size=30,
)


@settings(max_examples=10, deadline=None)
@given(raw_rows)
def test_cleaning_and_dedupe_commute(spark, rows):
    raw = spark.createDataFrame(rows, READING).repartition(3)
    first = rows_of(clean_readings(deduplicate(raw)))
    assert first == rows_of(deduplicate(clean_readings(raw)))
    assert first == rows_of(deduplicate(deduplicate(clean_readings(raw))))
    best = {}
    for household, day, kwh, stamp in rows:
        if None not in (household, day, kwh, stamp) and 0 <= kwh <= 100:
            key = (household, day, stamp)
            best[key] = min(kwh, best.get(key, kwh))
    assert {(r[0], r[1], r[3]): r[2] for r in first} == best


def test_profile_and_households(spark):
    raw = readings(spark, ("A", "2024-01-01 00:00", 1), ("A", "2024-01-01 01:00", 500), ("B", "2024-01-01 00:00", 1))
    assert rows_of(run_profile(raw)) == [(3, 2, 2)]
    assert rows_of(households(raw)) == [("A",), ("B",)]
