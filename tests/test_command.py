"""The steps as commands, one after the other."""

import pytest

from gridtally.__main__ import main
from gridtally.sources.tables import read_raw, read_table
from helpers import write_file


def test_steps_in_order(spark, tmp_path, capsys):
    folder = write_file(
        tmp_path / "in", "a.csv", "LCLid,day,energy_kwh,timestamp", "A,2024-01-01,0.125,2024-01-01 00:30:00"
    )
    write_file(tmp_path / "in", "block_1.csv", "LCLid,tstp,energy(kWh/hh)", "B,2024-01-02 00:30:00, 0.5 ")
    warehouse = f"{tmp_path}/warehouse"
    main(["check", folder])
    assert "2 files match *.csv" in capsys.readouterr().out
    main(["ingest", folder, warehouse, "--glob", "a*.csv", "--glob", "block_*.csv"])
    main(["ingest-new", folder, warehouse, "--glob", "a*.csv", "--glob", "block_*.csv"])
    assert read_raw(spark, warehouse).count() == 2
    main(["transform", warehouse])
    main(["load", warehouse])
    assert read_table(spark, warehouse, "daily").count() == 2
    main(["run", folder, warehouse, "--glob", "block_*.csv", "--max-kwh", "0.2"])
    assert read_table(spark, warehouse, "daily").count() == 1


def test_check_without_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        main(["check", str(tmp_path)])
