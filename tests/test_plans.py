"""Physical plans: what is pushed down, shuffled and joined."""

import ast
import datetime
from pathlib import Path

import pytest

from gridtally.operators import reports, rollups
from gridtally.operators.cleaning import clean_readings, deduplicate, identified
from gridtally.plans import registry
from gridtally.sources import tables
from helpers import plan_of

SF_DIR = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parent.parent / "gridtally"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("plans"))
    tables.append_readings(deduplicate(registry.events(spark, SF_DIR)), warehouse)
    return tables.read_raw(spark, warehouse)


def test_no_query_runs_python_or_cross_joins(spark):
    for name, query in registry.queries().items():
        plan = plan_of(query(spark, SF_DIR))
        for operator in ("Python", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin", "ObjectHash"):
            assert operator not in plan, (name, operator)


def test_filters_and_columns_reach_the_scan(raw):
    plan = plan_of(rollups.household_days(clean_readings(raw)))
    assert "GreaterThanOrEqua" in plan and "IsNotNull(lclid)" in plan
    read = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "created_at" not in read


def test_sums_are_made_before_each_shuffle(raw):
    for table in (rollups.household_days(clean_readings(raw)), deduplicate(identified(raw))):
        lines = plan_of(table).splitlines()
        exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
        assert len(exchanges) == 1
        assert "partial_" in lines[exchanges[0] + 1]
        assert not any("SortAggregate" in line for line in lines)


def test_energy_is_summed_as_a_long(raw):
    clean = clean_readings(raw)
    for table in (rollups.household_days(clean), rollups.hourly_rollup(clean)):
        assert "partial_sum(UnscaledValue(" in plan_of(table)


@pytest.mark.parametrize("rollup", [rollups.daily_rollup, rollups.household_stats])
def test_derived_rollups_shuffle_readings_once(raw, rollup):
    plan = plan_of(rollup(rollups.household_days(clean_readings(raw))))
    # household days, then the small result of their partial sums
    assert plan.count("Exchange hashpartitioning") == 2


def test_hours_shuffle_only_household_days_and_hour_sums(raw):
    plan = plan_of(rollups.hourly_rollup(clean_readings(raw)))
    lines = plan.splitlines()
    keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in lines if "Exchange hashpartitioning" in line]
    assert sum("lclid" in key for key in keys) == 1
    assert all("partial_" in lines[i + 1] for i, line in enumerate(lines) if "lclid" in line and "Exchange" in line)


def test_outliers_are_found_without_shuffling_readings(spark):
    found = registry.find_anomalies(spark, SF_DIR)
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_periods_reach_the_scan_of_the_stored_tables(spark, tmp_path):
    hourly = rollups.hourly_rollup(registry.events(spark, SF_DIR))
    daily = rollups.daily_rollup(rollups.household_days(registry.events(spark, SF_DIR)))
    for name, frame in (("hourly", hourly), ("daily", daily)):
        tables.write_dataset(frame, f"{tmp_path}/processed", name)
        tables.load_dataset(spark, f"{tmp_path}/processed", name, str(tmp_path))
    day = datetime.date(2024, 1, 5)
    hours = plan_of(reports.hourly_series(tables.read_table(spark, str(tmp_path), "hourly"), day, day, 1000))
    assert "GreaterThanOrEqual(hour,2024-01-05" in hours and "TakeOrderedAndProject" in hours
    days = plan_of(reports.daily_series(tables.read_table(spark, str(tmp_path), "daily"), day, day))
    assert "GreaterThanOrEqual(day,2024-01-05)" in days


def test_no_unbounded_collects_in_the_library():
    banned = {"collect", "toPandas", "toLocalIterator", "crossJoin", "localCheckpoint", "rdd", "udf"}
    # The optional package has tests of its own.
    for path in (p for p in PACKAGE.rglob("*.py") if "llm" not in p.parts):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in banned, (path, node.attr, node.lineno)
