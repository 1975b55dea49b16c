import os

import pytest

from strandloom import shared


def test_tables_are_kept_and_dropped(spark):
    kept = shared.keep(spark.range(5), "five")
    path = kept.path.removeprefix("file://")
    assert kept.df.count() == 5 and os.path.isdir(path)
    kept.drop()
    assert not os.path.exists(path)
    other = shared.keep(spark.range(3), "three").path.removeprefix("file://")
    shared.clean(spark)
    assert not os.path.exists(other)


class Fake:
    """A session with a setting and a master, nothing else."""

    def __init__(self, setting, master):
        self.conf = self
        self.sparkContext = self
        self.setting, self.master, self.applicationId = setting, master, f"app-{master}"

    def get(self, key, default=None):
        return self.setting or default


def test_the_folder_is_the_session_s():
    assert shared.shared_dir(Fake("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    own = Fake(None, "local[4]")
    assert shared.shared_dir(own) == shared.shared_dir(own) and shared.shared_dir(own).startswith("file://")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(Fake(None, master))


def test_spread_only_where_there_are_too_few_splits(spark):
    assert shared.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() > 1
    assert shared.spread(spark.range(10).repartition(7)).rdd.getNumPartitions() == 7
