import statistics

from pyspark.sql import functions as F

from gridtally.operators.anomalies import anomaly_top_households, detect_anomalies, household_baseline
from gridtally.operators.rollups import household_days
from gridtally.session import materialize
from helpers import D, plan_of, readings, rows_of, time


def hours(household, values, day="2024-01-"):
    return [(household, f"{day}{1 + i // 24:02d} {i % 24:02d}:00", v) for i, v in enumerate(values)]


def find(spark, rows, threshold=3.0, **options):
    raw = readings(spark, *rows)
    baseline = materialize(household_baseline(household_days(raw)), "baseline")
    return detect_anomalies(raw, baseline, threshold, **options)


def test_one_peak_among_eleven(spark):
    found = rows_of(find(spark, hours("A", [1] * 10 + [50])))
    # (n - 1) / sqrt(n) = 10 / sqrt(11)
    assert found == [("A", time("2024-01-01 10:00"), D("50.0000"), D("3.0151"), "outlier")]


def test_ten_readings_cannot_have_an_outlier(spark):
    assert find(spark, hours("A", [1] * 9 + [99])).count() == 0


def test_no_deviation_no_outlier(spark):
    assert find(spark, hours("A", ["0.1"] * 30) + hours("B", [7])).count() == 0
    baseline = {r["lclid"]: r for r in household_baseline(household_days(readings(
        spark, *hours("A", ["0.1"] * 30), *hours("B", [7])))).collect()}
    assert baseline["A"]["stddev_consumption"] == 0.0
    assert baseline["B"]["stddev_consumption"] is None


def test_low_values_are_outliers_too(spark):
    found = find(spark, hours("A", [90] * 20 + [0])).collect()
    assert [row["energy_kwh"] for row in found] == [D(0)]


def test_threshold(spark):
    rows = hours("A", [1] * 9 + [99])
    assert find(spark, rows, threshold=2.8).count() == 1


def test_baseline_matches_definition(spark):
    values = [0.5, 0.25, 1.75, 3.125, 0.0625, 2.5]
    row = household_baseline(household_days(readings(spark, *hours("A", values)))).first()
    assert row["reading_count"] == 6
    assert abs(float(row["mean_consumption"]) - statistics.mean(values)) < 1e-8
    assert abs(row["stddev_consumption"] - statistics.stdev(values)) < 1e-12


def test_scaling_leaves_scores_unchanged(spark):
    values = [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 20]
    single = find(spark, hours("A", values)).first()
    scaled = find(spark, hours("A", [4 * v for v in values])).first()
    assert single["z_score"] == scaled["z_score"]


def skewed(households=40):
    """One household has a third of all readings, another many but no outlier."""
    rows = []
    for i in range(households):
        rows += hours(f"H{i:02d}", [1] * 19 + [30 if i % 2 else 1])
    rows += hours("HOT", [2, 3] * 200 + [90])
    rows += hours("FLAT", [2] * 300)
    return rows


def test_shuffled_join_equals_broadcast(spark):
    rows = skewed()
    expected = rows_of(find(spark, rows))
    assert len(expected) == 21
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = find(spark, rows, max_broadcast_bytes=0, hot_share=0.01)
        assert "SortMergeJoin" in plan_of(shuffled)
        assert rows_of(shuffled) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_household_is_spread_over_several_keys(spark):
    from gridtally.operators.household_join import join_households
    from pyspark.sql import functions as F

    raw = readings(spark, *skewed())
    baseline = materialize(household_baseline(household_days(raw)), "baseline")
    joined = join_households(
        raw, baseline, F.lit(True), ["mean_consumption"], max_broadcast_bytes=0, hot_share=0.01
    )
    assert joined.count() == raw.count()
    logical = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in logical and "xxhash64" in logical


def test_long_names_are_not_broadcast(spark):
    limit = 20 * 120  # twenty rows with short names
    for name, way in (("H", "BroadcastHashJoin"), ("H" * 500, "SortMergeJoin")):
        rows = [row for i in range(20) for row in hours(f"{name}{i:02d}", [1] * 19 + [30])]
        found = find(spark, rows, max_broadcast_bytes=limit, hot_share=0.5)
        joins = [line for line in plan_of(found).splitlines() if "Join" in line and "lclid" in line]
        assert way in joins[0]
        assert found.count() == 20


def test_unwanted_readings_go_before_the_shuffle(spark):
    from gridtally.operators.household_join import join_households, perhaps_wanted

    raw = readings(spark, *[row for i in range(2000) for row in hours(f"H{i:04d}", [1, 2])])
    baseline = materialize(household_baseline(household_days(raw)), "baseline")
    wanted = F.col("lclid") < "H0100"
    chosen = baseline.where(wanted)
    left = perhaps_wanted(raw, chosen, 100)
    assert left.columns == raw.columns
    assert left.where("lclid < 'H0100'").count() == 200
    assert left.count() < 1000  # of 4000; an eighth of 3800 by chance
    joined = join_households(raw, baseline, wanted, ["mean_consumption"], max_broadcast_bytes=0)
    lines = plan_of(joined).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(lclid" in line]
    assert any("getbit" in line for line in lines[shuffles[0] :])
    assert joined.count() == 200


def test_top_households_break_ties_by_name(spark):
    found = find(spark, skewed(8))
    top = [tuple(row) for row in anomaly_top_households(found, 3).collect()]
    assert top == [("H01", 1), ("H03", 1), ("H05", 1)]
