from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridtally.session import SHUFFLE_CLEANUP, materialize, new_folder, shared_folder


def session(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_the_cluster_names_the_shared_folder():
    named = session(**{"spark.checkpoint.dir": "hdfs://shared/ck/", "spark.master": "yarn"})
    assert shared_folder(named) == "hdfs://shared/ck"
    assert new_folder(named, "x") != new_folder(named, "x")


def test_only_a_local_master_may_use_a_temporary_folder():
    assert shared_folder(session(**{"spark.master": "local[8]"}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(**{"spark.master": "yarn"}))


def test_materialized_table_is_read_back(spark):
    stored = materialize(spark.range(5), "five")
    assert sorted(row["id"] for row in stored.collect()) == [0, 1, 2, 3, 4]
    assert shared_folder(spark) in stored.inputFiles()[0]


def test_writer_options_reach_the_files(spark):
    assert ".gz" in materialize(spark.range(5), "packed", compression="gzip").inputFiles()[0]


def test_storing_a_table_leaves_no_setting_behind(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    stored = materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    assert stored.count() == 7
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
