"""Reading files: headers, layouts, values that do not parse."""

import pytest

from gridtally.operators.cleaning import clean_readings, deduplicate, identified
from gridtally.plans.pipeline import ingest
from gridtally.sources.csv_readings import (
    available_files,
    first_lines,
    read_csv_readings,
    rejected_of,
    scan_layouts,
)
from gridtally.sources.tables import read_rejected
from gridtally.streaming.incremental import ingest_new_files
from helpers import D, date, rows_of, time, write_file

HEADER = "LCLid,day,energy_kwh,timestamp"
ROW = ("A", date("2024-01-01"), D("0.1250"), time("2024-01-01 00:30"))


def test_columns_are_bound_by_name(spark, tmp_path):
    folder = write_file(
        tmp_path, "swapped.csv", "timestamp,energy_kwh,LCLid,day", "2024-01-01 00:30:00,0.125,A,2024-01-01"
    )
    assert rows_of(read_csv_readings(spark, folder)) == [ROW]


def test_extra_column_and_header_case(spark, tmp_path):
    folder = write_file(
        tmp_path, "a.csv", "note, lclid ,DAY,energy_kwh,timestamp", "x,A,2024-01-01,0.125,2024-01-01 00:30:00"
    )
    assert rows_of(read_csv_readings(spark, folder)) == [ROW]


def test_missing_column_is_named(spark, tmp_path):
    folder = write_file(tmp_path, "a.csv", "LCLid,energy_kwh,timestamp", "A,0.125,2024-01-01 00:30:00")
    with pytest.raises(ValueError, match="'day'"):
        read_csv_readings(spark, folder)


def test_missing_timestamp_column_is_null(spark, tmp_path):
    folder = write_file(tmp_path, "a.csv", "LCLid,day,energy_kwh", "A,2024-01-01,0.125")
    read = read_csv_readings(spark, folder)
    assert rows_of(read) == [ROW[:3] + (None,)]
    assert clean_readings(read).count() == 0


def test_values_that_do_not_parse_become_null(spark, tmp_path):
    folder = write_file(
        tmp_path,
        "a.csv",
        HEADER,
        "A,2024-13-01,0.1,2024-01-01 00:00:00",
        "B,2024-01-01,many,2024-01-01 00:00:00",
        "C,2024-01-01,NaN,2024-01-01 00:00:00",
        "D,2024-01-01,12345678,2024-01-01 00:00:00",
        "E,2024-01-01,0.1,",
        ",2024-01-01,0.1,2024-01-01 00:00:00",
        "G,2024-01-01,0.12345,2024-01-01 00:00:00",
    )
    read = {row["lclid"]: row for row in read_csv_readings(spark, folder).collect()}
    assert read["A"]["day"] is None
    assert [read[k]["energy_kwh"] for k in "BCD"] == [None] * 3
    assert read["E"]["timestamp"] is None
    assert read["G"]["energy_kwh"] == D("0.1235")
    kept = identified(read_csv_readings(spark, folder))
    assert sorted(row["lclid"] for row in kept.collect()) == ["E", "G"]


def test_half_hour_layout(spark, tmp_path):
    folder = write_file(
        tmp_path,
        "block_0.csv",
        "LCLid,tstp,energy(kWh/hh)",
        "A,2012-10-12 00:30:00.0000000, 0 ",
        "A,2012-10-12 01:00:00.0000000, 0.143 ",
        "A,2012-10-12 01:30:00.0000000,Null",
    )
    read = deduplicate(identified(read_csv_readings(spark, folder)))
    assert rows_of(read) == [
        ("A", date("2012-10-12"), D("0.0000"), time("2012-10-12 00:30")),
        ("A", date("2012-10-12"), D("0.1430"), time("2012-10-12 01:00")),
    ]


def test_both_layouts_in_one_folder(spark, tmp_path):
    write_file(tmp_path, "block_0.csv", "LCLid,tstp,energy(kWh/hh)", "B,2012-10-12 00:30:00.0000000, 0.5 ")
    folder = write_file(tmp_path, "readings.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    read = read_csv_readings(spark, folder, "block_*.csv", "readings*.csv")
    assert rows_of(read) == [ROW, ("B", date("2012-10-12"), D("0.5000"), time("2012-10-12 00:30"))]


def test_a_file_with_another_header_stops_the_scan(spark, tmp_path):
    write_file(tmp_path, "a.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    folder = write_file(tmp_path, "b.csv", "LCLid,day,timestamp,energy_kwh", "A,2024-01-01,2024-01-01 01:00:00,1")
    with pytest.raises(Exception, match="CSV header does not conform|header"):
        read_csv_readings(spark, folder, "*.csv").collect()


def test_a_mixed_folder_needs_no_globs(spark, tmp_path):
    write_file(tmp_path, "a b%20[1].csv", "", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    write_file(tmp_path, "c.csv", '"timestamp", energy_kwh ,LCLid,day', "2024-01-02 01:00:00,1,C,2024-01-02")
    write_file(tmp_path, "d.csv", HEADER, *["D,2024-01-03,2,2024-01-03 01:00:00"] * 3)
    write_file(tmp_path, "e.csv", "LCLid,tstp,energy(kWh/hh)", "E,2012-10-12 00:30:00.0000000, 0.5 ")
    write_file(tmp_path, "f.csv", "LCLid,day,energy_kwh", "F,2024-01-04,3")
    (tmp_path / "g.csv").write_text("")
    folder = write_file(tmp_path, "h.csv", HEADER)
    settings = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = read_csv_readings(spark, folder)
    assert rows_of(read) == [
        ROW,
        ("C", date("2024-01-02"), D("1.0000"), time("2024-01-02 01:00")),
        *[("D", date("2024-01-03"), D("2.0000"), time("2024-01-03 01:00"))] * 3,
        ("E", date("2012-10-12"), D("0.5000"), time("2012-10-12 00:30")),
        ("F", date("2024-01-04"), D("3.0000"), None),
    ]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == settings


def test_a_mixed_folder_with_an_unknown_header_is_refused(spark, tmp_path):
    write_file(tmp_path, "informations.csv", "LCLid,tariff", "A,Std")
    folder = write_file(tmp_path, "block_1.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    with pytest.raises(ValueError, match="energy_kwh"):
        read_csv_readings(spark, folder)


def test_first_lines_read_one_task_a_file(spark, tmp_path):
    for number in range(5):
        write_file(tmp_path, f"{number}.csv", f"name{number}", *["x" * 50] * (10 + 1000 * number))
    found = first_lines(spark, str(tmp_path), "*.csv")
    assert sorted(line for _, line in found) == [f"name{number}" for number in range(5)]


def test_first_lines_where_files_are_cut_and_packed(spark, tmp_path, monkeypatch):
    for number in range(6):
        write_file(tmp_path, f"{number}.csv", f"name{number}", *["x" * 50] * (3 + 30 * number))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    monkeypatch.setattr(type(session.conf), "set", lambda *_: None)
    monkeypatch.setattr(type(session), "newSession", lambda _: session)
    found = first_lines(spark, str(tmp_path), "*.csv")
    assert sorted(line for _, line in found) == [f"name{number}" for number in range(6)]


def test_rejected_rows_name_file_and_reason(spark, tmp_path):
    write_file(tmp_path, "half.csv", "LCLid,tstp,energy(kWh/hh)", *["A,2012-10-12 01:30:00.0000000,Null"] * 2)
    folder = write_file(
        tmp_path,
        "all.csv",
        HEADER + ",__source_file",
        "A,2024-01-01,0.125,2024-01-01 00:30:00,",
        ",2024-13-01,many,2024-01-01 00:30:00,x",
        "B,,1,,",
    )
    rejected = rejected_of(scan_layouts(spark, folder)).collect()
    seen = {(r["source_file"].rsplit("/")[-1], r["reason"], r["copies"], r["fields"]) for r in rejected}
    assert seen == {
        ("half.csv", "energy_kwh", 2, '{"LCLid":"A","tstp":"2012-10-12 01:30:00.0000000","energy(kWh/hh)":"Null"}'),
        (
            "all.csv",
            "lclid,day,energy_kwh",
            1,
            '{"day":"2024-13-01","energy_kwh":"many","timestamp":"2024-01-01 00:30:00","__source_file":"x"}',
        ),
        ("all.csv", "day", 1, '{"LCLid":"B","energy_kwh":"1"}'),
    }


def test_ingest_stores_rejected_rows_once(spark, tmp_path):
    warehouse = str(tmp_path / "warehouse")
    source = write_file(tmp_path / "in", "a.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    ingest(spark, source, warehouse)
    assert rows_of(read_rejected(spark, warehouse)) == []
    write_file(tmp_path / "in", "b.csv", "LCLid,tstp,energy(kWh/hh)", "A,2012-10-12 01:30:00.0000000,Null")
    for _ in range(2):
        assert ingest(spark, source, warehouse)["read"] == 2
    assert [(r["reason"], r["copies"]) for r in read_rejected(spark, warehouse).collect()] == [("energy_kwh", 1)]


def test_new_files_store_their_rejected_rows(spark, tmp_path):
    warehouse = str(tmp_path / "warehouse")
    source = write_file(tmp_path / "in", "a.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00", ",2024-01-01,1,")
    for _ in range(2):
        ingest_new_files(spark, source, warehouse)
    stored = read_rejected(spark, warehouse).collect()
    assert [(r["reason"], r["source_file"].rsplit("/")[-1]) for r in stored] == [("lclid", "a.csv")]


def test_glob_leaves_other_files_out(spark, tmp_path):
    write_file(tmp_path, "informations.csv", "LCLid,tariff", "A,Std")
    folder = write_file(tmp_path, "block_1.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    assert rows_of(read_csv_readings(spark, folder, "block_*.csv")) == [ROW]
    assert len(available_files(spark, folder, "block_*.csv")) == 1


@pytest.mark.parametrize("name", ["empty", "absent"])
def test_no_files(spark, tmp_path, name):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        available_files(spark, str(tmp_path / name))


def test_empty_files_and_files_with_a_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    write_file(tmp_path, "b.csv", HEADER)
    folder = write_file(tmp_path, "c.csv", HEADER, "A,2024-01-01,0.125,2024-01-01 00:30:00")
    assert rows_of(read_csv_readings(spark, folder)) == [ROW]
